"""Pair features: the base block. Pairs carry S1 columns plainly and candidate columns with _c."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import udf
from tessera.functions.text import jaccard, text, token_set, tokens, unpadded

COLUMNS = ["n_core", "n_compact", "n_alias", "n_legal", "n_kind", "n_script", "a_full", "a_street", "a_house", "a_numbers", "a_postcode", "a_state", "a_empty"]
# The codes of a candidate's name kind.
KINDS = {"name": 0, "domain": 1, "handle": 2, "empty": 3}


def attach(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """pairs with the columns of both sides, null strings as ''; every pair keeps one row."""
    own = [c for c in columns if c in s1.columns]
    clean = lambda df, c: text(c) if dict(df.dtypes)[c] == "string" else F.col(c)
    left = s1.select(F.col("entity_id").alias("s1_id"), "country", *[clean(s1, c).alias(c) for c in own])
    right = pool.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("country_c"), F.col("source").alias("source_c"), *[clean(pool, c).alias(f"{c}_c") for c in own])
    return pairs.join(left, "s1_id").join(right, "cand_id")


def similarities(pairs: DataFrame) -> DataFrame:
    """The Arrow UDF block: token-set, token-sort, plain and partial indel similarities and Jaro-Winkler."""
    wanted = {
        "name_tset": ("token_set_ratio", "n_core", "n_core_c"), "name_tsort": ("token_sort_ratio", "n_core", "n_core_c"), "name_ratio": ("ratio", "n_core", "n_core_c"), "name_partial": ("partial_ratio", "n_core", "n_core_c"),
        "comp_jw": ("jaro_winkler", "n_compact", "n_compact_c"), "comp_partial": ("partial_ratio", "n_compact", "n_compact_c"), "alias_tset": ("token_set_ratio", "n_core", "n_alias_c"),
        "addr_tset": ("token_set_ratio", "a_full", "a_full_c"), "addr_ratio": ("ratio", "a_full", "a_full_c"), "street_tset": ("token_set_ratio", "a_street", "a_street_c"),
    }
    return pairs.withColumns({name: udf(f)(a, b) for name, (f, a, b) in wanted.items()})


def substitution(a: Column, b: Column) -> Column:
    """Strings of one length that differ at one place."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return (F.char_length(a) == F.char_length(b)) & (differ == 1)


def house_rel(a: str = "a_house", b: str = "a_house_c") -> Column:
    """Codes: 8 both empty, 7 one empty, 0 equal, 3 equal without leading zeros, 1 suffix, 2 prefix, 4 one substitution,
    5 digits of each as numbers within 10 (eight digits at most), 6 other."""
    x, y = text(a), text(b)
    p, q = (F.regexp_replace(s, "[^0-9]", "") for s in (x, y))
    short = (F.char_length(p).between(1, 8)) & (F.char_length(q).between(1, 8))
    near = short & (F.abs(p.try_cast("bigint") - q.try_cast("bigint")) <= 10)
    return (
        F.when((x == "") & (y == ""), 8).when((x == "") | (y == ""), 7).when(x == y, 0).when(unpadded(a) == unpadded(b), 3)
        .when(x.endswith(y) | y.endswith(x), 1).when(x.startswith(y) | y.startswith(x), 2).when(substitution(x, y), 4)
        .when(F.coalesce(near, F.lit(False)), 5).otherwise(6)
    )


def legal_rel(a: str = "n_legal", b: str = "n_legal_c") -> Column:
    """Codes: 0 both empty, 1 equal, 2 one empty, 3 disjoint, 4 overlapping."""
    x, y = text(a), text(b)
    common = F.size(F.array_intersect(token_set(a), token_set(b)))
    return F.when((x == "") & (y == ""), 0).when(x == y, 1).when((x == "") | (y == ""), 2).when(common == 0, 3).otherwise(4)


def built_in(pairs: DataFrame) -> DataFrame:
    """The block of built-in expressions: relations, token counts, states, kinds."""
    s, c = token_set("n_core"), token_set("n_core_c")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("n_kind_c")], F.lit(0))
    state = F.when((text("a_state") == "") | (text("a_state_c") == ""), 2).when(F.col("a_state") == F.col("a_state_c"), 1).otherwise(0)
    return pairs.withColumns(
        {
            "house_rel": house_rel(), "num_jacc": jaccard(tokens("a_numbers"), tokens("a_numbers_c")), "legal_rel": legal_rel(),
            "extra_tok": F.size(F.array_except(c, s)), "missing_tok": F.size(F.array_except(s, c)), "common_tok": F.size(F.array_intersect(s, c)),
            "state_rel": state, "cand_addr_empty": F.col("a_empty_c").cast("int"), "cand_kind": kind, "cand_native": (F.col("n_script_c") != "latin").cast("int"),
            "cand_src": (F.col("source_c") == 3).cast("int"), "len_core_s1": F.size(tokens("n_core")), "len_core_c": F.size(tokens("n_core_c")),
        }
    )


def rank_gap(pairs: DataFrame, name: str = "name_tset", addr: str = "addr_tset") -> DataFrame:
    """Ranks by similarity within an S1 (equal values share the smaller rank), the gap to its best name, its size."""
    group = Window.partitionBy("s1_id")
    rank = lambda c: F.rank().over(group.orderBy(F.desc(c)))
    return pairs.withColumns({"name_rank_in_s1": rank(name), "addr_rank_in_s1": rank(addr), "name_gap_s1": F.max(name).over(group) - F.col(name), "n_cand_s1": F.count("*").over(group)})


def featurize(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """The whole base block."""
    return rank_gap(built_in(similarities(attach(pairs, s1, pool))))


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left with right's columns; a key that either side has twice, or that right lacks, is an error."""
    for name, df in (("left", left), ("right", right)):
        if df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"the {name} side has a key twice")
    if left.join(right, key, "left_anti").limit(1).count():
        raise ValueError("a key has no partner")
    return left.join(right, key)


def with_cosines(pairs: DataFrame, bands: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the encoder cosines of those in the uncertain band (s1_id, cand_id, columns), null for the others."""
    return pairs.join(bands.select("s1_id", "cand_id", *columns), ["s1_id", "cand_id"], "left")


#: Feature groups by the beginnings of their names; the first that fits is a feature's group.
GROUPS = {"G7": ("ps_", "xs_"), "G6": ("twin_",), "G5": ("sib_",), "G4": ("house_", "sec_num", "postcode_"), "G3": ("ex_", "mi_", "edit_", "sub_", "first_tok", "s1_prefix", "c_prefix"), "G2": ("s1_addr", "pool_addr", "s1_hs", "a_key", "hs_key"), "G1": ("s1_name", "pool_name", "n_key")}


def group_of(feature: str) -> str:
    """The context group of a feature; base for those of the base block."""
    return "base" if feature == "house_rel" else next((g for g, starts in GROUPS.items() if feature.startswith(starts)), "base")


def without_groups(features: list[str], *groups: str) -> list[str]:
    """The features that an ablation of the groups leaves."""
    return [f for f in features if group_of(f) not in groups]


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label: whether the pair is in truth (s1_id, match_id)."""
    marked = truth.select("s1_id", F.col("match_id").alias("cand_id"), F.lit(True).alias("label")).distinct()
    return pairs.join(marked, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
