"""A training corpus from documents: toxicity, near duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents;
the last returns the packed pieces. Columns that documents do not have may have any names and go in the first stage. Empty
tables stay empty; null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, secrets, toxicity
from tessera.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row() -> Column:
    """A row is known by a digest of its doc_id, null included, and its text: doc_ids may be null or repeated."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit("")))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not predict as toxic; its labels are those of sf_dir's table.

    Every row is decided by its own text: rows without a doc_id go if they are toxic, and a clean row stays though a
    toxic one has the same doc_id. Repeated rows go or stay together.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", row())
    scores = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key="_row")
    toxic = scores.where("predicted = 1").select("_row").distinct()
    return docs.join(toxic, "_row", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: of the smallest doc_id, a null one last; among rows of that doc_id
    the one of the smallest digest; among identical rows one, by lang, source and n_chars. Rows without words are in no
    component and all stay. A row stays though a copy of another row has its doc_id.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", row())
    found = jaccard.jaccard_components(docs, key="_row").where("n_shingles > 0").select("class", "_row", "doc_id")
    found = written(found, "near-duplicate-classes")  # nothing stands on the join by class, so that a hot class of it can be split
    rows = found.groupBy("class", "_row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = written(rows, "near-duplicate-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = rows.groupBy("class").agg(F.min(order).alias("kept"), F.sum("n").alias("size")).where("size > 1")
    kept = written(kept, "near-duplicate-kept")  # a plain table, so that a hot class of the join can be split
    several = rows.join(kept.select("class", F.col("kept._row").alias("kept")), "class")
    gone = several.where("_row <> kept").select("_row")
    again = several.where("_row = kept AND n > 1").select("_row")
    docs = docs.repartition("_row")
    one = F.row_number().over(Window.partitionBy("_row").orderBy("lang", "source", "n_chars"))
    first = docs.join(again, "_row", "left_semi").withColumn("_at", one).where("_at = 1")
    single = docs.join(gone.unionByName(again), "_row", "left_anti")
    return single.select(*COLUMNS).unionByName(first.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is replaced by a mark and n_chars follows; all rows stay, those with null or repeated
    doc_ids as well, and null texts stay null."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: rows that agree in doc_id, null included, text and source alike. They stand in the
    order of the mix: a file holds runs of one output shard in the shard's shuffled order."""
    mixed = mixing.mixed_rows(docs.select(*COLUMNS))
    # 4096 ranges of place for each shard, so that a shard is no one task's
    mixed = mixed.repartition("mix_shard", F.shiftright("mix_place", 52)).sortWithinPartitions("mix_shard", "mix_place")
    return mixed.select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row: null and repeated doc_ids are rows like others, and repeats of a row go to different groups."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_documents),
]

#: Tokenizers, learned scores and hashed draws have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
