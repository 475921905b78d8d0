"""Robustness: density-matched scores, removal of reference entities, where scores are lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import md5_unit, uniform
from tessera.functions.text import sorted_key, unpadded
from tessera.operators.decision import f05


def band_mass(preds: DataFrame, low: float = 0.05, high: float = 0.98) -> DataFrame:
    """One row: candidates per S1 whose probability lies in the uncertain band."""
    inside = F.col("prob").between(low, high)
    return preds.agg((F.sum(inside.cast("int")) / F.countDistinct("s1_id")).alias("band"))


def negative_weight(rho: float, band: float, pos: float) -> float:
    """How often a band negative must count so that the band holds rho times its mass; 1 at least."""
    return max(1.0, (rho * band - pos) / (band - pos)) if band > pos else 1.0


def copies(labeled: DataFrame, w: float, low: float = 0.05, high: float = 0.98) -> DataFrame:
    """labeled (prob, label) with copies: band negatives count floor(w) times and once more with the fraction's chance,
    drawn from a hash of the pair."""
    whole = int(w)
    extra = (uniform(F.col("s1_id"), F.col("cand_id")) < (w - whole)).cast("int")
    return labeled.withColumn("copies", F.when(~F.col("label") & F.col("prob").between(low, high), whole + extra).otherwise(1))


def dm_entity_f05(labeled: DataFrame, spine: DataFrame, t: float | Column) -> DataFrame:
    """s1_id, tp, fp, fn, f05 with copies as weights of false matches; spine has n_true. t may be a column."""
    hit = F.col("prob") >= t
    agg = labeled.groupBy("s1_id").agg(F.sum((hit & F.col("label")).cast("int")).alias("tp"), F.sum(F.when(hit & ~F.col("label"), F.col("copies")).otherwise(0)).alias("fp"))
    rows = spine.join(agg, "s1_id", "left").na.fill(0, ["tp", "fp"]).withColumn("fn", F.col("n_true") - F.col("tp"))
    part = 1.25 * F.col("tp") + 0.25 * F.col("fn") + F.col("fp")
    return rows.withColumn("f05", F.when(part == 0, 1.0).otherwise(1.25 * F.col("tp") / F.nullif(part, F.lit(0))))


def twin_flag(s1: DataFrame) -> DataFrame:
    """entity_id, shared (another S1 of the country has its name or address key), twin (another of its name key has
    another house number, leading zeros aside)."""
    k = s1.select("entity_id", "country", sorted_key("n_core").alias("n_key"), sorted_key("a_full").alias("a_key"), unpadded("a_house").alias("house"))
    size = lambda key: F.when(F.col(key) != "", F.count("*").over(Window.partitionBy("country", key))).otherwise(0)
    places = F.size(F.collect_set("house").over(Window.partitionBy("country", "n_key")))
    return k.withColumns({"shared": (size("n_key") > 1) | (size("a_key") > 1), "twin": (F.col("n_key") != "") & (places > 1)}).select("entity_id", "shared", "twin")


VARIANTS = ("uniform", "biased", "twin")

# Removal rate, variant, and whether the data is thinned to a target density first.
SCENARIOS = {
    "clean": (0.0, "uniform", False),
    "u19": (0.19, "uniform", False),
    "b19": (0.19, "biased", False),
    "u30": (0.30, "uniform", False),
    "b30": (0.30, "biased", False),
    "t19": (0.19, "uniform", True),
    "tclean": (0.0, "uniform", True),
    "tw25": (0.25, "twin", False),
    "tw50": (0.50, "twin", False),
}


def removal_mask(s1: DataFrame, rate: float, variant: str = "uniform", salt: str = "|orphan") -> DataFrame:
    """entity_id and removed: whether a simulation takes the S1 away, from md5 of its id alone.

    biased doubles the rate of S1 that share an address and halves the others', rescaled to the rate on average; twin
    takes only S1 with a twin, at the rate.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    if rate <= 0:
        return s1.select("entity_id", F.lit(False).alias("removed"))
    unit = md5_unit(F.col("entity_id"), salt)
    rows = s1.select("entity_id").withColumn("u", unit)
    if variant == "uniform":
        return rows.select("entity_id", (F.col("u") < rate).alias("removed"))
    flags = rows.join(twin_flag(s1), "entity_id")
    if variant == "twin":
        return flags.select("entity_id", (F.col("twin") & (F.col("u") < rate)).alias("removed"))
    weight = F.when(F.col("shared"), 2.0).otherwise(0.5)
    mean = flags.agg(F.avg(weight).alias("mean"))
    return flags.join(F.broadcast(mean)).select("entity_id", (F.col("u") < F.least(F.lit(1.0), rate * weight / F.col("mean"))).alias("removed"))


def loss_decomposition(scores: DataFrame) -> DataFrame:
    """One row: 1 - macro F0.5 split into false matches on singletons, other false matches (what dropping them would
    gain) and misses (the rest)."""
    loss, single = 1 - F.col("f05"), F.col("n_true") == 0
    clean = f05(F.col("tp"), F.col("n_true"), F.col("tp"))
    wrong, missed = (F.when(~single, x).otherwise(0.0) for x in (clean - F.col("f05"), 1 - clean))
    return scores.agg(F.avg(loss).alias("loss"), F.avg(F.when(single, loss).otherwise(0.0)).alias("fp_singleton"), F.avg(wrong).alias("fp_other"), F.avg(missed).alias("fn"))


def fp_sources(pred: DataFrame, truth: DataFrame, removed: DataFrame) -> DataFrame:
    """owner and n of false matches: records without any owner, of a removed S1, of another S1."""
    wrong = pred.join(truth, ["s1_id", "match_id"], "left_anti")
    owner = truth.select("match_id", F.col("s1_id").alias("owner_id")).join(removed.select(F.col("entity_id").alias("owner_id"), "removed"), "owner_id", "left")
    kind = F.when(F.col("owner_id").isNull(), "none").when(F.coalesce("removed", F.lit(False)), "removed").otherwise("other")
    return wrong.join(owner, "match_id", "left").groupBy(kind.alias("owner")).agg(F.count("*").alias("n"))


def simulate(s1: DataFrame, preds: DataFrame, rate: float, variant: str) -> tuple[DataFrame, DataFrame]:
    """Surviving S1 and their predictions after a removal; truth of removed S1 goes with them."""
    gone = removal_mask(s1, rate, variant).where("removed").select("entity_id")
    left = s1.join(gone, "entity_id", "left_anti")
    return left, preds.join(gone.withColumnRenamed("entity_id", "s1_id"), "s1_id", "left_anti")


def thinned(s1: DataFrame, pool: DataFrame, truth: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id) of S1 and of pool records that go when each country keeps a share (country, keep; 1 where absent) of its
    S1 by md5 of the id: records go with their S1, those without an owner by their own id."""

    def gone(df: DataFrame) -> DataFrame:
        share = df.select("entity_id", "country").join(keep, "country", "left")
        return share.where(md5_unit(F.col("entity_id"), "|thin") >= F.coalesce("keep", F.lit(1.0))).select("entity_id")

    left_out = gone(s1)
    owned = truth.join(left_out.withColumnRenamed("entity_id", "s1_id"), "s1_id", "left_semi").select(F.col("match_id").alias("entity_id"))
    free = pool.join(truth.select(F.col("match_id").alias("entity_id")), "entity_id", "left_anti")
    return left_out, owned.unionByName(gone(free)).distinct()


def scenario(
    s1: DataFrame, pool: DataFrame, truth: DataFrame, pairs: DataFrame, score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], rate: float, variant: str, keep: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Surviving S1, surviving pool and the predictions of `score` on the surviving pairs.

    Removed S1 leave their records behind; where keep is given, thinned S1 take theirs along. score gets the survivors, so
    that what it derives from all S1 or all records is derived again.
    """
    gone = removal_mask(s1, rate, variant).where("removed").select("entity_id")
    if keep is not None:
        thin, records = thinned(s1, pool, truth, keep)
        gone = gone.unionByName(thin)
        pool = pool.join(records, "entity_id", "left_anti")
        pairs = pairs.join(records.withColumnRenamed("entity_id", "cand_id"), "cand_id", "left_anti")
    s1 = s1.join(gone, "entity_id", "left_anti")
    pairs = pairs.join(gone.withColumnRenamed("entity_id", "s1_id"), "s1_id", "left_anti")
    return s1, pool, score(s1, pool, pairs)
