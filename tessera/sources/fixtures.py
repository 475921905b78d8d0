"""Views that put the record-linkage shapes onto the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import compact


def drec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized records from documents: three sources by key arithmetic, names and addresses from the first words.

    Letters beyond ASCII stand as "e": SQL engines differ in whether edit distance counts letters or bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    # only the first thirteen words count, so the text is not split beyond them
    words = F.filter(F.split(F.lower("text"), r"[\x00-\x7F&&[^a-z0-9]]+", 20), lambda t: t != "")
    toks = F.transform(F.slice(words, 1, 13), lambda t: F.regexp_replace(t, r"[^\x00-\x7F]", "e"))
    cut = lambda a, n: F.array_join(F.slice("toks", a, n), " ")
    empty = F.col("doc_id") % 29 == 0
    out = docs.withColumn("toks", toks).select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        (1 + F.col("doc_id") % 3).cast("int").alias("source"),
        F.col("lang").alias("country"),
        "doc_id",
        cut(1, 5).alias("n_core"),
        F.when(F.col("doc_id") % 7 == 0, cut(12, 2)).otherwise("").alias("n_alias"),
        F.element_at(F.array(*[F.lit(x) for x in ("", "ltd", "ltd pvt", "inc")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("n_legal"),
        F.when(F.col("doc_id") % 41 == 0, "domain").when(F.col("doc_id") % 43 == 0, "handle").otherwise("name").alias("n_kind"),
        F.when(F.col("doc_id") % 37 == 0, "devanagari").otherwise("latin").alias("n_script"),
        F.when(empty, "").otherwise(cut(6, 6)).alias("a_full"),
        F.when(empty, "").otherwise(cut(6, 5)).alias("a_street"),
        F.when(empty, "").otherwise((F.col("n_chars") % 1000).cast("string")).alias("a_house"),
        F.when(empty, "").otherwise(F.concat_ws(" ", (F.col("n_chars") % 1000).cast("string"), F.concat(F.lit("0"), (F.col("n_chars") % 17).cast("string")))).alias("a_numbers"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise((10000 + F.col("n_chars") % 50).cast("string")).alias("a_postcode"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("st"), (F.col("n_chars") % 4).cast("string"))).alias("a_state"),
        empty.alias("a_empty"),
    )
    return out.withColumn("n_compact", compact("n_core"))


def prec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a small vocabulary from part: dense blocks."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    source = F.when(F.col("p_partkey") % 10 == 0, 1).when(F.col("p_partkey") % 2 == 0, 2).otherwise(3)
    return p.select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        source.alias("source"),
        F.col("p_type").alias("country"),
        F.col("p_name").alias("n_core"),
        F.concat_ws(" ", "p_brand", "p_name").alias("a_full"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("a_street"),
        F.col("p_size").cast("string").alias("a_house"),
    )


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1 (reference entities) and the pool (noisy records)."""
    return records.where("source = 1"), records.where("source <> 1")


def loose_truth(records: DataFrame) -> DataFrame:
    """(s1_id, match_id): same country and n_core, the smallest S1 id owning a record."""
    s1, pool = split(records)
    q = s1.where("n_core <> ''").groupBy("country", "n_core").agg(F.min("entity_id").alias("s1_id"))
    return pool.join(q, ["country", "n_core"]).select("s1_id", F.col("entity_id").alias("match_id"))
