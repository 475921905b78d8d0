"""Reading records, truth and folds; integrity checks; deterministic samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import md5_mod

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated strings with doubled quotes; empty fields are '', and words like NA stay words."""
    df = spark.read.csv(path, schema=schema, sep="\t", quote='"', escape='"', header=True).na.fill("")
    return df.select(*columns) if columns else df


def read_source(spark: SparkSession, path: str, countries: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet records; the country predicate and the projection reach the scan."""
    df = spark.read.parquet(path)
    if countries is not None:
        df = df.where(F.col("country").isin(countries))
    return df.select(*columns) if columns else df


def stack_sources(sources: dict[int, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(n).cast("tinyint")) for n, df in sources.items()])


def source_of(entity_id: str = "entity_id") -> F.Column:
    return F.substring(entity_id, 2, 1).cast("tinyint")


def truth_pairs(raw: DataFrame, s1: DataFrame | None = None) -> DataFrame:
    """(s1_id, match_id) from comma lists; singletons absent; only ids of s1 (s1_id) where given."""
    pairs = raw.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.filter(F.split("matched_entity_ids", ","), lambda m: m != "")).alias("match_id"))
    return pairs.join(s1, "s1_id", "left_semi") if s1 is not None else pairs


def truth_sets(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every S1 of the spine with its sorted set of matches, empty for singletons."""
    sets = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("match_id")).alias("matches"))
    return spine.join(sets, "s1_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))


def folds(s1: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """s1_id, country, n_matches, fold = md5 mod k, mini and micro subsets of fold 0, and fold 0 without mini."""
    n = pairs.groupBy("s1_id").agg(F.countDistinct("match_id").alias("n_matches"))
    part = md5_mod(F.concat(F.lit("sub"), F.col("s1_id")), 100)
    out = s1.select("s1_id", "country").join(n, "s1_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("smallint")).withColumn("fold", md5_mod(F.col("s1_id"), k).cast("tinyint"))
    return out.withColumn("mini", (F.col("fold") == 0) & (part < 20)).withColumn("micro", (F.col("fold") == 0) & (part < 2)).withColumn("fold0x", (F.col("fold") == 0) & ~F.col("mini"))


def integrity(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of violations: repeated ids, ids with a wrong prefix, truth ids without an S1 or a record, records with
    more than one owner. All are zero for sound data."""
    s1 = records.where("source = 1").select(F.col("entity_id").alias("s1_id"))
    pool = records.where("source <> 1").select(F.col("entity_id").alias("match_id"))
    many = lambda df, key: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    checks = {
        "repeated_ids": many(records, ["entity_id"]),
        "wrong_prefix": records.where(source_of() != F.col("source")),
        "unknown_s1": pairs.join(s1, "s1_id", "left_anti"),
        "unknown_match": pairs.join(pool, "match_id", "left_anti"),
        "shared_matches": many(pairs.distinct(), ["match_id"]),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, the same in every run: the first by md5 of the key and the seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def audit_samples(records: DataFrame, truth: DataFrame, clusters: int = 400, distractors: int = 300, seed: int = 7) -> DataFrame:
    """(kind, id): S1 with matches, and pool records without an owner, for reading by people."""
    owned = truth.select(F.col("s1_id").alias("id")).distinct()
    free = records.where("source <> 1").select(F.col("entity_id").alias("id")).join(truth.select(F.col("match_id").alias("id")), "id", "left_anti")
    return hash_sample(owned, "id", clusters, seed).withColumn("kind", F.lit("cluster")).unionByName(hash_sample(free, "id", distractors, seed).withColumn("kind", F.lit("distractor")))


def load_cache(parts: list[DataFrame]) -> DataFrame:
    """Candidate caches of different versions as one: missing columns null, kmask from the low retriever bits where it is
    missing, role flags from `role`."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "kmask" not in out.columns:
        out = out.withColumn("kmask", F.lit(None).cast("int"))
    out = out.withColumn("kmask", F.coalesce("kmask", F.col("rbits").bitwiseAND(15)))
    return out.withColumn("is_es", F.coalesce(F.col("role") == "es", F.lit(False))) if "role" in out.columns else out


def numbered(df: DataFrame, key: str, name: str = "row", prefix: int = 6) -> DataFrame:
    """df with row numbers from 0 in the order of a string key: numbers within a prefix of the key, plus the rows of all
    smaller prefixes, so no task orders the whole table."""
    df = df.withColumn("_p", F.substring(key, 1, prefix))
    sizes = df.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return df.withColumn("_k", inside).join(starts, "_p").withColumn(name, F.col("_from") + F.col("_k")).drop("_p", "_k", "_from")


def text_export(records: DataFrame, offset: int = 0) -> DataFrame:
    """(row, text) for encoders: name and address joined, numbered from offset in id order, without entity ids."""
    text = F.concat_ws(" | ", F.coalesce("n_core", F.lit("")), F.coalesce("a_full", F.lit("")))
    return numbered(records, "entity_id").select((F.col("row") + offset).alias("row"), text.alias("text"))


def countries(df: DataFrame) -> DataFrame:
    """The countries of a table, found in the data."""
    return df.select("country").distinct()
