"""Context features: how unique a name or address is, token rarity, sibling consensus, name twins, competition.

Statistics are over all S1 and pool records of the split; group features need an S1's complete candidate list, which a
window partitioned by s1_id has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import udf
from tessera.functions.text import BIZ_WORDS, house_street_raw_key, sorted_key, text, token_set, tokens

# Caps of counts, of twins compared and of raw document frequencies, and the idf where none is known.
COUNT_CAP, TWIN_MAX, DF_CAP, IDF_UNKNOWN, SIBLING_MIN = 20, 30, 50, 15.0, 80.0


@dataclass
class SplitContext:
    """Key counts, token statistics and twins of a split, each a lazy table."""

    s1_name: DataFrame
    s1_addr: DataFrame
    s1_house: DataFrame
    pool_name: DataFrame
    pool_addr: DataFrame
    df: DataFrame
    n_s1: DataFrame
    twins: DataFrame


def with_keys(records: DataFrame) -> DataFrame:
    return records.withColumns({"n_key": sorted_key("n_core"), "a_key": sorted_key("a_full"), "hs_key": house_street_raw_key()})


def key_counts(records: DataFrame, key: str, name: str) -> DataFrame:
    return records.where(F.col(key) != "").groupBy("country", key).agg(F.count("*").alias(name))


def split_context(s1: DataFrame, pool: DataFrame) -> SplitContext:
    a, b = with_keys(s1), with_keys(pool)
    toks = a.select("entity_id", "country", F.explode(token_set("n_core")).alias("tok"))
    n_s1 = a.groupBy("country").agg(F.count("*").alias("n_s1"))
    few = key_counts(a, "n_key", "n").where(F.col("n") <= TWIN_MAX)
    twins = a.join(few, ["country", "n_key"], "left_semi").select("entity_id", "country", "n_key", "a_full", "a_street", "a_house")
    return SplitContext(key_counts(a, "n_key", "n"), key_counts(a, "a_key", "n"), key_counts(a, "hs_key", "n"), key_counts(b, "n_key", "n"), key_counts(b, "a_key", "n"), toks.groupBy("country", "tok").agg(F.count("*").alias("df")), n_s1, twins)


def idf(ctx: SplitContext) -> DataFrame:
    """(country, tok, idf, idf_max): ln(n_s1 / df), and the country's largest."""
    out = ctx.df.join(ctx.n_s1, "country").withColumn("idf", F.log(F.col("n_s1") / F.col("df")))
    return out.withColumn("idf_max", F.max("idf").over(Window.partitionBy("country"))).select("country", "tok", "idf", "idf_max")


def keyed_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with both sides' name, address and house-street keys."""
    own = {"n_key": sorted_key("n_core"), "a_key": sorted_key("a_full"), "hs_key": house_street_raw_key()}
    cand = {"n_key_c": sorted_key("n_core_c"), "a_key_c": sorted_key("a_full_c"), "hs_key_c": house_street_raw_key("a_house_c", "a_street_c")}
    return pairs.withColumns(own | cand)


def _count(pairs: DataFrame, counts: DataFrame, key: str, on: str, name: str) -> DataFrame:
    """name: how many records of counts have the pair's key, 0 without one, at most COUNT_CAP."""
    side = counts.select("country", F.col(key).alias(on), F.col("n").alias("_n"))
    return pairs.join(side, ["country", on], "left").withColumn(name, F.least(F.coalesce("_n", F.lit(0)), F.lit(COUNT_CAP))).drop("_n")


def g1_names(pairs: DataFrame, ctx: SplitContext) -> DataFrame:
    for counts, on, name in ((ctx.s1_name, "n_key_c", "s1_name_c"), (ctx.s1_name, "n_key", "s1_name_self"), (ctx.pool_name, "n_key_c", "pool_name_c"), (ctx.pool_name, "n_key", "pool_name_self")):
        pairs = _count(pairs, counts, "n_key", on, name)
    equal = (F.col("n_key") == F.col("n_key_c")) & (F.col("n_key") != "")
    return pairs.withColumns({"s1_name_c_one": (F.col("s1_name_c") == 1).cast("int"), "s1_name_self_one": (F.col("s1_name_self") == 1).cast("int"), "n_key_equal": equal.cast("int")})


def g2_places(pairs: DataFrame, ctx: SplitContext) -> DataFrame:
    for counts, key, on, name in ((ctx.s1_addr, "a_key", "a_key_c", "s1_addr_c"), (ctx.s1_addr, "a_key", "a_key", "s1_addr_self"), (ctx.pool_addr, "a_key", "a_key_c", "pool_addr_c"), (ctx.s1_house, "hs_key", "hs_key_c", "s1_hs_c")):
        pairs = _count(pairs, counts, key, on, name)
    same = lambda k: ((F.col(k) == F.col(f"{k}_c")) & (F.col(k) != "")).cast("int")
    return pairs.withColumns({"a_key_equal": same("a_key"), "hs_key_equal": same("hs_key")})


def _edit_stats(pairs: DataFrame, ctx: SplitContext, tok_list: Column, pre: str, version: int) -> DataFrame:
    rows = pairs.select("s1_id", "cand_id", "country", F.explode(tok_list).alias("tok"))
    flags = [F.max(F.col("tok").isin(BIZ_WORDS).cast("int")).alias(f"{pre}_biz"), F.max(F.col("tok").rlike("[0-9]").cast("int")).alias(f"{pre}_digit")]
    if version < 2:
        known = idf(ctx)
        most = known.groupBy("country").agg(F.max("idf_max").alias("idf_max"))
        rows = rows.join(known.drop("idf_max"), ["country", "tok"], "left").join(most, "country", "left").withColumn("idf", F.coalesce("idf", "idf_max", F.lit(IDF_UNKNOWN)))
        return rows.groupBy("s1_id", "cand_id").agg(F.max("idf").alias(f"{pre}_idf_max"), F.min("idf").alias(f"{pre}_idf_min"), F.sum("idf").alias(f"{pre}_idf_sum"), *flags)
    rows = rows.join(ctx.df, ["country", "tok"], "left").join(ctx.n_s1, "country", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    low = F.log1p(F.least("df", F.lit(DF_CAP)))
    common = F.when(F.col("df") >= DF_CAP, F.log(F.col("df") / F.col("n_s1")))
    return rows.groupBy("s1_id", "cand_id").agg(F.sum((F.col("df") == 0).cast("int")).alias(f"{pre}_unseen_n"), F.min(low).alias(f"{pre}_ldf_min"), F.max(low).alias(f"{pre}_ldf_max"), F.max(common).alias(f"{pre}_lfrac_cmax"), F.min(common).alias(f"{pre}_lfrac_cmin"), *flags)


def g3_edits(pairs: DataFrame, ctx: SplitContext, version: int = 3) -> DataFrame:
    """Extra and missing name tokens of the candidate: how many, how rare, of what kind, and the type of edit.

    first_tok_eq compares the first tokens in text order."""
    ts, tc = token_set("n_core"), token_set("n_core_c")
    extra, missing = F.array_except(tc, ts), F.array_except(ts, tc)
    pairs = pairs.withColumns({"ex_n": F.size(extra), "mi_n": F.size(missing)})
    for pre, toks in (("ex", extra), ("mi", missing)):
        pairs = pairs.join(_edit_stats(pairs, ctx, toks, pre, version), ["s1_id", "cand_id"], "left")
        fills = {f"{pre}_biz": 0, f"{pre}_digit": 0} | ({f"{pre}_idf_{k}": 0.0 for k in ("max", "min", "sum")} if version < 2 else {f"{pre}_unseen_n": 0, f"{pre}_ldf_min": -1.0, f"{pre}_ldf_max": -1.0})
        pairs = pairs.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})
    s, c = text("n_core"), text("n_core_c")
    kind = F.when((F.col("ex_n") == 0) & (F.col("mi_n") == 0), 0).when(F.col("mi_n") == 0, 1).when(F.col("ex_n") == 0, 2).otherwise(3)
    first = F.coalesce(F.get(tokens("n_core"), F.lit(0)) == F.get(tokens("n_core_c"), F.lit(0)), F.lit(False))
    return pairs.withColumns({"edit_type": kind, "s1_prefix_of_c": ((s != "") & c.startswith(F.concat(s, F.lit(" ")))).cast("int"), "c_prefix_of_s1": ((c != "") & s.startswith(F.concat(c, F.lit(" ")))).cast("int"), "first_tok_eq": first.cast("int")})


def substitution_similarity(pairs: DataFrame) -> DataFrame:
    """sub_jw: the best Jaro-Winkler of an extra and a missing token, -1 without both; only such pairs reach the UDF."""
    ts, tc = token_set("n_core"), token_set("n_core_c")
    both = pairs.select("s1_id", "cand_id", F.explode(F.array_except(tc, ts)).alias("x"), F.array_except(ts, tc).alias("m")).select("s1_id", "cand_id", "x", F.explode("m").alias("y"))
    distinct = both.select("x", "y").distinct().withColumn("jw", udf("jaro_winkler")("x", "y"))
    best = both.join(distinct, ["x", "y"]).groupBy("s1_id", "cand_id").agg(F.max("jw").alias("sub_jw"))
    return pairs.join(best, ["s1_id", "cand_id"], "left").withColumn("sub_jw", F.coalesce("sub_jw", F.lit(-1.0)))


def g4_house(pairs: DataFrame) -> DataFrame:
    h, hc = text("a_house"), text("a_house_c")
    both = (h != "") & (hc != "")
    n1, n2 = (F.expr(f"try_cast(nullif(regexp_extract(coalesce({c}, ''), '([0-9]{{1,9}})', 1), '') as bigint)") for c in ("a_house", "a_house_c"))
    gap = F.abs(n1 - n2)
    s1, s2 = F.array_except(tokens("a_numbers"), F.array(h)), F.array_except(tokens("a_numbers_c"), F.array(hc))
    p, pc = text("a_postcode"), text("a_postcode_c")
    flag = lambda e: F.when(both, e.cast("int")).otherwise(-1)
    return pairs.withColumns(
        {
            "house_lev": F.when(both, F.levenshtein(h, hc)).otherwise(-1),
            "house_logdiff": F.coalesce(F.when(both, F.log1p(gap)), F.lit(-1.0)),
            "house_reldiff": F.coalesce(F.when(both, gap / F.greatest(n1, n2, F.lit(1))), F.lit(-1.0)),
            "house_same_len": flag(F.char_length(h) == F.char_length(hc)),
            "house_first_diff": flag(F.substring(h, 1, 1) != F.substring(hc, 1, 1)),
            "house_last_diff": flag(F.right(h, F.lit(1)) != F.right(hc, F.lit(1))),
            "sec_num_rel": F.when(F.size(F.array_union(s1, s2)) == 0, -1).when((F.size(s1) == 0) | (F.size(s2) == 0), 0).when(F.size(F.array_intersect(s1, s2)) > 0, 1).otherwise(2),
            "postcode_rel": F.when((p == "") & (pc == ""), 0).when(p == pc, 1).when((p == "") | (pc == ""), 2).otherwise(3),
        }
    )


def g5_siblings(pairs: DataFrame, name: str = "name_tset", least: float = SIBLING_MIN) -> DataFrame:
    """Leave-one-out agreement with the S1's other name-similar candidates; needs n_key_c."""
    hc = text("a_house_c")
    sib = ((F.col(name) >= least) & (hc != "")).cast("int")
    at_home = sib * (hc == text("a_house")).cast("int")
    over = lambda e, *keys: F.sum(e).over(Window.partitionBy("s1_id", *keys))
    cap = lambda e, low=0: F.least(F.greatest(e, F.lit(low)), F.lit(COUNT_CAP))
    pairs = pairs.withColumns(
        {
            "sib_n": cap(over(sib) - sib),
            "sib_house_agree": F.when(hc != "", cap(over(sib, "a_house_c") - sib, -1)).otherwise(-1),
            "sib_s1house_agree": cap(over(at_home) - at_home),
            "sib_namekey_same": cap(F.count("*").over(Window.partitionBy("s1_id", "n_key_c")) - 1),
        }
    )
    share = lambda c: F.when(F.col("sib_n") > 0, F.greatest(F.col(c), F.lit(0)) / F.col("sib_n")).otherwise(-1.0)
    return pairs.withColumns({"sib_house_frac": share("sib_house_agree"), "sib_s1house_frac": share("sib_s1house_agree")})


def g6_twins(pairs: DataFrame, ctx: SplitContext, address=None, street=None, whole=None) -> DataFrame:
    """Competition of other S1 with the candidate's name key: margins own - best are null without a twin.

    address, street and whole are similarity expressions of two columns (Arrow UDFs by default); needs n_key_c. A key
    that more than TWIN_MAX S1 share is too generic to compare.
    """
    address, street, whole = address or udf("token_set_ratio"), street or udf("token_set_ratio"), whole or udf("ratio")
    t = ctx.twins.select(F.col("entity_id").alias("_tid"), "country", F.col("n_key").alias("n_key_c"), F.col("a_full").alias("_ta"), F.col("a_street").alias("_ts"), F.col("a_house").alias("_th"))
    j = pairs.where("n_key_c <> ''").select("s1_id", "cand_id", "country", "n_key_c", "a_full_c", "a_street_c", "a_house_c").join(t, ["country", "n_key_c"]).where("_tid <> s1_id")
    same = (text("_th") == text("a_house_c")) & (text("_th") != "")
    j = j.select("s1_id", "cand_id", address("_ta", "a_full_c").alias("_a"), street("_ts", "a_street_c").alias("_s"), whole("_ts", "a_street_c").alias("_r"), same.alias("_heq"))
    best = j.groupBy("s1_id", "cand_id").agg(F.count("*").alias("twin_n"), F.max("_a").alias("twin_addr_best"), F.max("_s").alias("_bs"), F.max("_r").alias("_br"), F.max(F.when(F.col("_heq"), F.col("_r"))).alias("_hr"), F.max(F.col("_heq").cast("int")).alias("twin_house_eq"))
    generic = ctx.s1_name.where(F.col("n") > TWIN_MAX).select("country", F.col("n_key").alias("n_key_c"), F.lit(1).alias("twin_generic"))
    out = pairs.join(best, ["s1_id", "cand_id"], "left").join(generic, ["country", "n_key_c"], "left")
    out = out.withColumns({"_oa": address("a_full", "a_full_c"), "_os": street("a_street", "a_street_c"), "_or": whole("a_street", "a_street_c")})
    return out.withColumns(
        {
            "twin_n": F.coalesce("twin_n", F.lit(0)), "twin_house_eq": F.coalesce("twin_house_eq", F.lit(0)), "twin_generic": F.coalesce("twin_generic", F.lit(0)),
            "twin_addr_margin": F.col("_oa") - F.col("twin_addr_best"), "twin_street_margin": F.col("_os") - F.col("_bs"), "twin_street_ratio_margin": F.col("_or") - F.col("_br"),
            "twin_hs_better": (F.coalesce("_hr", F.lit(-1.0)) > F.col("_or")).cast("int"),
        }
    ).drop("_oa", "_os", "_or", "_bs", "_br", "_hr")


def g7_per_source(pairs: DataFrame, scores: tuple[str, ...] = ("name_tset", "addr_tset", "cos_na"), high: float = 90.0) -> DataFrame:
    """Competition within (S1, source of the candidate): rank, gap to the best, how many at `high`, size; and the other
    source's best. Null scores count as -1."""
    group = Window.partitionBy("s1_id", "cand_src")
    out = pairs.withColumn("ps_n", F.count("*").over(group))
    other = []
    for c in scores:
        v = F.coalesce(c, F.lit(-1.0))
        out = out.withColumns({f"ps_{c}_rank": F.rank().over(group.orderBy(v.desc())), f"ps_{c}_gap": F.max(v).over(group) - v, f"ps_{c}_n90": F.sum((v >= high).cast("int")).over(group)})
        other.append(F.max(v).alias(f"xs_{c}_max"))
    best = pairs.groupBy("s1_id", (1 - F.col("cand_src")).alias("cand_src")).agg(*other)
    return out.join(best, ["s1_id", "cand_src"], "left").withColumns({f"xs_{c}_max": F.coalesce(f"xs_{c}_max", F.lit(-1.0)) for c in scores})


def q05(c: str | Column) -> Column:
    """Rounded to halves, ties to even; null stays null."""
    return F.bround((F.col(c) if isinstance(c, str) else c) / 0.5) * 0.5


def add_features(pairs: DataFrame, ctx: SplitContext, groups: tuple[str, ...] = ("G1", "G2", "G3", "G4", "G5"), version: int = 3) -> DataFrame:
    """The chosen groups on pairs that carry both sides' columns and name_tset."""
    out = keyed_pairs(pairs)
    steps = {"G1": lambda x: g1_names(x, ctx), "G2": lambda x: g2_places(x, ctx), "G3": lambda x: substitution_similarity(g3_edits(x, ctx, version)), "G4": g4_house, "G5": g5_siblings, "G6": lambda x: g6_twins(x, ctx) if version >= 4 else x, "G7": g7_per_source}
    for g in groups:
        out = steps[g](out)
    return out
