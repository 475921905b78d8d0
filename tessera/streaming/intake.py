"""Record intake as a stream: exact-key retrieval of arriving records against a static table of entities.

An addition of this engine: every micro-batch joins on the same capped keys as the batch retrievers, so a record's
candidates do not depend on when it arrives. Caps are taken from the static side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_entities(s1: DataFrame, key: Column, cap: int) -> DataFrame:
    """(country, key, s1_id) of the entities whose key no more than cap of them share."""
    rows = s1.select("country", key.alias("key"), F.col("entity_id").alias("s1_id")).where("key <> ''")
    ok = rows.groupBy("country", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("country", "key")
    return rows.join(ok, ["country", "key"], "left_semi")


def retrieve(records: DataFrame, entities: DataFrame, key: Column) -> DataFrame:
    """(s1_id, cand_id) of a stream (or table) of records by a stream-static equi-join; needs no state."""
    rows = records.select("country", key.alias("key"), F.col("entity_id").alias("cand_id"))
    return rows.join(entities, ["country", "key"]).select("s1_id", "cand_id")
