"""Entity-level scores, blocking reports and audits. Entities without predictions or candidates always count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import text, unpadded
from tessera.operators.decision import f05


def entity_scores(pred: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp, fp, fn, f05 for every S1 of the spine; pred and truth are (s1_id, match_id)."""
    t = truth.select("s1_id", "match_id").distinct().withColumn("t", F.lit(1))
    p = pred.select("s1_id", "match_id").distinct().withColumn("p", F.lit(1))
    both = t.join(p, ["s1_id", "match_id"], "full").groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("tp"))
    rows = spine.join(both, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return rows.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_true") - F.col("tp"), "f05": f05(F.col("tp"), F.col("n_true"), F.col("n_pred"))})


def macro_f05(scores: DataFrame) -> float:
    row = scores.agg(F.avg("f05").alias("m")).first()
    if row.m is None:
        raise ValueError("no entities to score")
    return row.m


def report(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, pair precision and recall (1 on 0/0), singletons and how many are left alone (null without
    any), entities with a false match, mean predictions."""
    total = lambda c: F.sum(c)
    single = F.col("n_true") == 0
    return scores.agg(
        F.count("*").alias("n"), F.avg("f05").alias("macro_f05"),
        F.coalesce(total("tp") / F.nullif(total("n_pred"), F.lit(0)), F.lit(1.0)).alias("pair_precision"),
        F.coalesce(total("tp") / F.nullif(total("n_true"), F.lit(0)), F.lit(1.0)).alias("pair_recall"),
        F.avg(single.cast("double")).alias("singleton_rate"), F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))).alias("singleton_acc"),
        F.sum((F.col("fp") > 0).cast("int")).alias("entities_with_fp"), F.avg("n_pred").alias("avg_pred"),
    )


def report_by(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.count("*").alias("n"), F.avg("f05").alias("f05"))


def by_true_count(scores: DataFrame, most: int = 6) -> DataFrame:
    return report_by(scores.withColumn("n_true_capped", F.least("n_true", F.lit(most))), "n_true_capped")


def paired_bootstrap(a: DataFrame, b: DataFrame, n: int = 1000) -> DataFrame:
    """One row (delta, low, high, p_not_better): mean gain of b over a by S1, with a Poisson bootstrap.

    Each S1 weighs Poisson(1) in each replicate, from a hash of its id and the replicate, so replicates are sums over
    the cluster and only n of them meet.
    """
    d = a.select("s1_id", F.col("f05").alias("fa")).join(b.select("s1_id", F.col("f05").alias("fb")), "s1_id").withColumn("d", F.col("fb") - F.col("fa"))
    cdf, p, c = [], float(np.exp(-1)), 0.0
    for k in range(1, 9):
        c += p
        cdf.append(c)
        p /= k
    u = F.pmod(F.xxhash64("s1_id", "r"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= v, 1).otherwise(0) for v in cdf), F.lit(0))
    reps = d.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    mean = d.agg(F.avg("d").alias("delta"))
    return mean.join(F.broadcast(reps.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_better"))))


def blocking_report(cands: DataFrame, truth: DataFrame, spine: DataFrame, pool_size: int) -> DataFrame:
    """One row: pair recall, entities with all matches found, candidates per S1 (mean, median, 95th, most), S1 without
    candidates, reduction ratio."""
    pairs = cands.select("s1_id", F.col("cand_id").alias("match_id")).distinct()
    hits = truth.join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "match_id"], "left").groupBy("s1_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("found"))
    size = pairs.groupBy("s1_id").agg(F.count("*").alias("c"))
    rows = spine.join(hits, "s1_id", "left").join(size, "s1_id", "left").na.fill(0, ["n_true", "found", "c"])
    return rows.agg(
        (F.sum("found") / F.nullif(F.sum("n_true"), F.lit(0))).alias("pair_recall"), F.avg(F.when(F.col("n_true") > 0, (F.col("found") == F.col("n_true")).cast("double"))).alias("full_coverage"),
        F.avg("c").alias("mean_candidates"), F.expr("percentile(c, 0.5)").alias("p50_candidates"), F.expr("percentile(c, 0.95)").alias("p95_candidates"), F.max("c").alias("max_candidates"),
        F.avg((F.col("c") == 0).cast("double")).alias("empty_rate"), (1 - F.sum("c") / (F.count("*") * F.lit(pool_size))).alias("reduction_ratio"),
    )


def recall_by_country(cands: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    pairs = cands.select("s1_id", F.col("cand_id").alias("match_id"), F.lit(1).alias("hit")).distinct()
    return truth.join(spine.select("s1_id", "country"), "s1_id").join(pairs, ["s1_id", "match_id"], "left").groupBy("country").agg(F.count("*").alias("n_true"), (F.count("hit") / F.count("*")).alias("recall"))


def marginal_recall(cands: DataFrame, truth: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(retriever, pairs, alone, marginal): recall of one retriever alone, and what the union loses without it."""
    marked = truth.join(cands.select("s1_id", F.col("cand_id").alias("match_id"), "rbits"), ["s1_id", "match_id"], "left").withColumn("rbits", F.coalesce("rbits", F.lit(0)))
    has = lambda b: (F.col("rbits").bitwiseAND(F.lit(b)) != 0).cast("double")
    only = lambda b: ((F.col("rbits") != 0) & (F.col("rbits").bitwiseAND(F.bitwise_not(F.lit(b))) == 0)).cast("double")
    one = marked.agg(*[e for name, b in bits.items() for e in (F.avg(has(b)).alias(f"a_{name}"), F.avg(only(b)).alias(f"m_{name}"))])
    sizes = cands.agg(*[F.sum(has(b)).cast("long").alias(f"n_{name}") for name, b in bits.items()])
    cells = [F.struct(F.lit(n).alias("retriever"), F.coalesce(f"n_{n}", F.lit(0)).alias("pairs"), F.col(f"a_{n}").alias("alone"), F.col(f"m_{n}").alias("marginal")) for n in bits]
    return one.join(F.broadcast(sizes)).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def recall_at(cands: DataFrame, truth: DataFrame, score: str, caps: tuple[int, ...] = (50, 150, 200)) -> DataFrame:
    """(cap, recall): recall if each S1 kept its `cap` best candidates."""
    best = Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id")
    ranked = cands.select("s1_id", "cand_id", F.row_number().over(best).alias("r")).withColumnRenamed("cand_id", "match_id")
    hit = truth.join(ranked, ["s1_id", "match_id"], "left")
    cells = F.array(*[F.struct(F.lit(c).alias("cap"), (F.coalesce(F.col("r"), F.lit(2**31)) <= c).cast("double").alias("hit")) for c in caps])
    return hit.select(F.explode(cells).alias("c")).groupBy("c.cap").agg(F.avg("c.hit").alias("recall"))


def miss_audit(missed: DataFrame) -> DataFrame:
    """bucket, addr_state and count of missed pairs with both sides' columns, name_tset and name_ratio; the first
    bucket that holds is a pair's."""
    bucket = (
        F.when(F.col("n_script_c") != "latin", "native_script").when(F.col("n_kind_c") == "empty", "empty_name").when(F.col("n_kind_c").isin("domain", "handle"), "domain_handle")
        .when(text("n_alias_c") != "", "alias").when(F.col("name_tset") >= 90, "name_near_identical").when((F.col("name_tset") >= 70) & (F.col("name_ratio") < 80), "name_extra_or_reorder")
        .when(F.col("name_ratio") >= 60, "name_typo_moderate").otherwise("name_heavy_diff")
    )
    state = (
        F.when(F.col("a_empty_c"), "cand_addr_empty").when(text("a_house_c") == "", "cand_no_house").when(text("a_house") == text("a_house_c"), "house_equal")
        .when(unpadded("a_house") == unpadded("a_house_c"), "house_zero_pad").otherwise("house_diff")
    )
    return missed.withColumns({"bucket": bucket, "addr_state": state}).groupBy("bucket", "addr_state").agg(F.count("*").alias("n"))


def pivoted(counts: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row with a column for each value, 0 where none, and their total."""
    out = counts.groupBy(row).pivot(column, values).agg(F.sum("n")).na.fill(0)
    return out.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))
