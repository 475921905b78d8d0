"""Sessions, and making this package importable on Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators are tuned for; on a cluster, set partitions by its cores."""
    builder = SparkSession.builder.appName("tessera")
    defaults = {
        "spark.master": master,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start from now on import this package, wherever the driver runs."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
