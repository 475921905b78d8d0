"""Exact-key retrievers: capped equi-joins of reference entities and pool records within a country.

Every retriever yields (s1_id, cand_id) and owns one bit of RBITS. A cap drops keys with too many pool records before the
join, so a frequent key never multiplies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STREET_STOP, house_street_key, name_number_keys, skeleton, sorted_key, text, token_set, tokens

# Retriever bits, and the types, bits and caps of the typed keys.
RBITS = {"keys_v0": 1, "tf_name": 2, "tf_na": 4, "akey": 8, "hskey": 16, "tf_empty": 32, "skel": 64, "rev": 128, "nkey_empty": 256, "nkey_num": 512}
KEY_BITS = {"A": 1, "N1": 2, "N2": 4, "C": 8}
KEY_CAPS = {"A": 150, "N1": 200, "N2": 100, "C": 60}


def core_tokens(records: DataFrame) -> DataFrame:
    """(entity_id, country, t): distinct name tokens of three characters or more."""
    return records.select("entity_id", "country", F.explode(F.filter(token_set("n_core"), lambda t: F.char_length(t) >= 3)).alias("t"))


def token_df(pool: DataFrame) -> DataFrame:
    """Pool records by (country, token)."""
    return core_tokens(pool).groupBy("country", "t").agg(F.count("*").alias("df"))


def make_keys(records: DataFrame, df: DataFrame) -> DataFrame:
    """(entity_id, country, kt, key), distinct: house and street word (A), rarest name token (N1), the two rarest (N2),
    the first ten letters of the compact name and of the alias (C)."""
    base = records.select("entity_id", "country", *[text(c).alias(c) for c in ("n_compact", "n_alias", "a_house", "a_street")])
    street = base.where("a_house <> ''").select("entity_id", "country", "a_house", F.explode(tokens("a_street")).alias("t"))
    a = street.where((F.char_length("t") >= 4) & ~F.col("t").isin(STREET_STOP)).select("entity_id", "country", F.lit("A").alias("kt"), F.concat_ws("|", "a_house", "t").alias("key"))
    rare = core_tokens(records).join(df, ["country", "t"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("country", "entity_id").orderBy("df", "t"))
    top = rare.withColumn("r", rank).where("r <= 2")
    n1 = top.where("r = 1").select("entity_id", "country", F.lit("N1").alias("kt"), F.col("t").alias("key"))
    two = top.groupBy("entity_id", "country").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") == 2)
    n2 = two.select("entity_id", "country", F.lit("N2").alias("kt"), F.array_join("ts", "|").alias("key"))
    c1 = base.where(F.char_length("n_compact") >= 6).select("entity_id", "country", F.lit("C").alias("kt"), F.substring("n_compact", 1, 10).alias("key"))
    c2 = base.where(F.char_length("n_alias") >= 6).select("entity_id", "country", F.lit("C").alias("kt"), F.substring(F.regexp_replace("n_alias", " ", ""), 1, 10).alias("key"))
    return reduce(DataFrame.unionByName, [a, n1, n2, c1, c2]).distinct()


def cap_keys(keys: DataFrame, caps: dict[str, int] = KEY_CAPS) -> DataFrame:
    """Pool keys without those of more records than their type's cap."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    ok = keys.groupBy("country", "kt", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cap[F.col("kt")])
    return keys.join(ok.select("country", "kt", "key"), ["country", "kt", "key"], "left_semi")


def keys_v0(s1: DataFrame, pool: DataFrame, caps: dict[str, int] = KEY_CAPS) -> DataFrame:
    """(s1_id, cand_id, kmask): pairs that share a capped typed key, with the OR of the types' bits."""
    df = token_df(pool)
    p = cap_keys(make_keys(pool, df), caps).withColumnRenamed("entity_id", "cand_id")
    q = make_keys(s1, df).withColumnRenamed("entity_id", "s1_id")
    bit = F.create_map(*[F.lit(x) for kv in KEY_BITS.items() for x in kv])
    return q.join(p, ["country", "kt", "key"]).groupBy("s1_id", "cand_id").agg(F.bit_or(bit[F.col("kt")]).cast("int").alias("kmask"))


def key_join(s1: DataFrame, pool: DataFrame, key: Column | tuple[Column, Column], cap: int, min_len: int = 1) -> DataFrame:
    """(s1_id, cand_id) of equal keys within a country; short keys never join, keys of more than cap pool records are
    dropped. A key may be an array: then any element joins, and the cap counts distinct records."""
    qk, pk = key if isinstance(key, tuple) else (key, key)

    def keyed(df: DataFrame, k: Column, name: str) -> DataFrame:
        out = df.select("country", F.col("entity_id").alias(name), k.alias("key"))
        if out.schema["key"].dataType.typeName() == "array":
            out = out.withColumn("key", F.explode("key")).distinct()
        return out.where(F.char_length("key") >= min_len)

    q, p = keyed(s1, qk, "s1_id"), keyed(pool, pk, "cand_id")
    ok = p.groupBy("country", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("country", "key")
    return q.join(p.join(ok, ["country", "key"], "left_semi"), ["country", "key"]).select("s1_id", "cand_id").distinct()


def akey(s1: DataFrame, pool: DataFrame, cap: int = 100) -> DataFrame:
    return key_join(s1, pool, sorted_key("a_full"), cap)


def hskey(s1: DataFrame, pool: DataFrame, cap: int = 100) -> DataFrame:
    return key_join(s1, pool, house_street_key(), cap)


def skel(s1: DataFrame, pool: DataFrame, cap: int = 100) -> DataFrame:
    return key_join(s1, pool, skeleton("n_core"), cap, 4)


def nkey_empty(s1: DataFrame, pool: DataFrame, cap: int = 300) -> DataFrame:
    """Equal sorted names against pool records without an address."""
    return key_join(s1, pool.where("a_empty"), sorted_key("n_core"), cap, 3)


def nkey_num(s1: DataFrame, pool: DataFrame, cap: int = 50) -> DataFrame:
    return key_join(s1, pool, name_number_keys(), cap)


def prefix_key(s1: DataFrame, pool: DataFrame, cap: int = 300, n: int = 8) -> DataFrame:
    """The template's key: country and the first letters of the compact name, above four characters in all."""
    key = F.concat_ws("|", text("country"), F.substring(text("n_compact"), 1, n))
    return key_join(s1, pool, key, cap, 5)


def union(parts: dict[str, DataFrame]) -> DataFrame:
    """(s1_id, cand_id, rbits): distinct pairs with the OR of their retrievers' bits."""
    every = reduce(DataFrame.unionByName, [df.select("s1_id", "cand_id", F.lit(RBITS[name]).alias("bit")) for name, df in parts.items()])
    return every.groupBy("s1_id", "cand_id").agg(F.bit_or("bit").alias("rbits"))


def union_with_mask(parts: dict[str, DataFrame]) -> DataFrame:
    """union, with the typed keys' mask of the part that has one, 0 elsewhere."""
    mask = lambda df: F.col("kmask") if "kmask" in df.columns else F.lit(0).alias("kmask")
    every = reduce(DataFrame.unionByName, [df.select("s1_id", "cand_id", F.lit(RBITS[name]).alias("bit"), mask(df)) for name, df in parts.items()])
    return every.groupBy("s1_id", "cand_id").agg(F.bit_or("bit").alias("rbits"), F.bit_or("kmask").alias("kmask"))


def with_key_mask(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """pairs with the typed keys' mask, 0 where no typed key holds."""
    return pairs.join(keyed.select("s1_id", "cand_id", "kmask"), ["s1_id", "cand_id"], "left").withColumn("kmask", F.coalesce("kmask", F.lit(0)))


def cap_per_query(pairs: DataFrame, score: str, cap: int = 100) -> DataFrame:
    """Each S1's best `cap` candidates, ties to the smaller cand_id."""
    best = Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id")
    return pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= cap).drop("_r")


def augment(pairs: DataFrame, extra: DataFrame, bit: int) -> DataFrame:
    """Adds a retriever to existing pairs: new pairs get its bit alone, known ones the bit as well."""
    fresh = extra.select("s1_id", "cand_id").withColumn("_bit", F.lit(bit))
    both = pairs.join(fresh, ["s1_id", "cand_id"], "full")
    return both.withColumn("rbits", F.coalesce("rbits", F.lit(0)).bitwiseOR(F.coalesce("_bit", F.lit(0)))).drop("_bit")


def key_parts(s1: DataFrame, pool: DataFrame, keyed: DataFrame) -> dict[str, DataFrame]:
    """Pairs of each exact-key retriever; keyed are those of keys_v0."""
    return {"keys_v0": keyed, "akey": akey(s1, pool), "hskey": hskey(s1, pool), "skel": skel(s1, pool), "nkey_empty": nkey_empty(s1, pool), "nkey_num": nkey_num(s1, pool)}


def candidates(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """All exact-key retrievers over all countries in one plan."""
    keyed = keys_v0(s1, pool)
    return with_key_mask(union(key_parts(s1, pool, keyed)), keyed)
