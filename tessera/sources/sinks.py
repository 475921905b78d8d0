"""Writers of match and candidate lists, grouped Parquet, run records, and checks of what was written."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def match_lists(matches: DataFrame, spine: DataFrame, order: str | None = None) -> DataFrame:
    """source1_entity_id, matched_entity_ids and the spine's place: one row for each S1 of spine (s1_id, place).

    Ids are stripped, repeated ones kept once, others than S2- and S3- dropped. Unknown S1 raise. Ids stand in the order of
    the column `order` of matches, a repeated one at its first place; without it they are sorted.
    """
    unknown = matches.join(spine, "s1_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown S1 {unknown[0].s1_id}")
    m = matches.withColumn("match_id", F.trim("match_id")).where(F.col("match_id").rlike("^S[23]-"))
    first = m.groupBy("s1_id", "match_id").agg((F.min(order) if order else F.lit(0)).alias("at"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "match_id"))), lambda x: x["match_id"])
    lists = first.groupBy("s1_id").agg(F.array_join(ids, ",").alias("matched_entity_ids"))
    return spine.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"), "place")


def write_match_tsv(lists: DataFrame, path: str) -> dict[str, int]:
    """Writes lists in the spine's order with LF endings; rows without a match keep their tab. Returns counts."""
    out = lists.orderBy("place").select("source1_entity_id", "matched_entity_ids")
    out.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, lineSep="\n", emptyValue="", quote="")
    n = lists.agg(F.count("*").alias("rows"), F.sum((F.col("matched_entity_ids") != "").cast("int")).alias("with_match"), F.sum(F.size(F.filter(F.split("matched_entity_ids", ","), lambda x: x != ""))).alias("pairs")).first()
    return {"rows": n.rows, "with_match": n.with_match or 0, "pairs": n.pairs or 0}


def candidate_lists(cands: DataFrame, matches: DataFrame) -> tuple[DataFrame, int]:
    """(s1_id, candidates) as sorted comma lists, and how many matches are among the candidates."""
    lists = cands.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("candidates"))
    inside = matches.join(cands.select("s1_id", F.col("cand_id").alias("match_id")).distinct(), ["s1_id", "match_id"], "left_semi").count()
    return lists, inside


def validate(lists: DataFrame, spine: DataFrame) -> DataFrame:
    """(rule, n): rows that break the submission's rules; all zero for a valid list."""
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    missing = spine.join(lists.select(F.col("source1_entity_id").alias("s1_id")), "s1_id", "left_anti")
    owners = lists.select("source1_entity_id", F.explode(ids).alias("m")).groupBy("m").agg(F.countDistinct("source1_entity_id").alias("n")).where("n > 1")
    repeated = lists.groupBy("source1_entity_id").agg(F.count("*").alias("n")).where("n > 1")
    wrong = lists.where(F.exists(ids, lambda x: ~x.rlike("^S[23]-")))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r, df in (("missing_s1", missing), ("shared_match", owners), ("repeated_s1", repeated), ("wrong_prefix", wrong))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def diagnostics(lists: DataFrame, spine: DataFrame) -> DataFrame:
    """country, rate of S1 without a match, mean matches."""
    n = F.size(F.filter(F.split("matched_entity_ids", ","), lambda x: x != ""))
    return lists.withColumn("s1_id", F.col("source1_entity_id")).join(spine.select("s1_id", "country"), "s1_id").groupBy("country").agg(F.avg((n == 0).cast("double")).alias("empty_rate"), F.avg(n).alias("mean_matches"))


def write_grouped(df: DataFrame, path: str, key: str = "s1_id") -> None:
    """Parquet in which a key's rows stand together in one file."""
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_by_tag(df: DataFrame, path: str, tag: str = "tag") -> None:
    df.write.mode("overwrite").partitionBy(tag).parquet(path)


def record_run(spark: SparkSession, path: str, name: str, metrics: dict, notes: str = "") -> str:
    """Adds a run's record as JSON; its id."""
    run = f"{datetime.now(UTC):%Y%m%d-%H%M%S}_{name}"
    row = json.dumps({"run": run, "name": name, "metrics": metrics, "notes": notes}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)
    return run


def leaderboard(spark: SparkSession, path: str, metric: str = "macro_f05") -> DataFrame:
    """Runs by a metric, best first."""
    runs = spark.read.schema(f"run string, name string, notes string, metrics map<string,double>").json(path)
    return runs.select("run", "name", F.col("metrics")[metric].alias(metric)).orderBy(F.desc_nulls_last(metric), "run")


def load_predictions(spark: SparkSession, path: str, kind: str, threshold: float | None = None) -> DataFrame:
    """(s1_id, match_id) from pairs or probabilities in Parquet, or from a match-list TSV."""
    if kind == "pairs":
        return spark.read.parquet(path).select("s1_id", "match_id")
    if kind == "probs":
        return spark.read.parquet(path).where(F.col("prob") >= (0.5 if threshold is None else threshold)).select("s1_id", F.col("cand_id").alias("match_id"))
    raw = spark.read.csv(path, sep="\t", header=True, schema="s1_id string, ids string").na.fill("")
    return raw.select("s1_id", F.explode(F.filter(F.split("ids", ","), lambda m: m != "")).alias("match_id"))
