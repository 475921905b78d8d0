"""Registration of queries: a Spark plan, its SQL, and the columns both return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPARK = {"s": lambda c: c.cast("string"), "i": lambda c: c.cast("long"), "b": lambda c: c.cast("boolean"), "d": lambda c: F.round(c.cast("double"), 6)}
DUCK = {"s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "b": "CAST({0} AS BOOLEAN)", "d": "round(CAST({0} AS DOUBLE), 6)"}


def query(name: str, columns: str, sql: str | None = None):
    """Registers a plan under a name. columns is "name:kind ..." with kinds s, i, b and d (string, 64-bit integer,
    boolean, double rounded to 6 places); both engines return exactly these."""
    kinds = dict(c.split(":") for c in columns.split())

    def add(plan: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(importable(spark), sf_dir).select(*[SPARK[k](F.col(c)).alias(c) for c, k in kinds.items()])

        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = "SELECT " + ", ".join(f'{DUCK[k].format(c)} AS {c}' for c, k in kinds.items()) + f" FROM ({sql.strip()}) AS answer"
        return plan

    return add
