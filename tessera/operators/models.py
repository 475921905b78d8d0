"""Learned parts: pair models by pyspark.ml, calibration, out-of-fold scores, token maps, hard negatives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions.text import tokens


def _assembled(features: list[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), model])


def train_gbt(rows: DataFrame, features: list[str], label: str = "y", stop: str | None = None, rounds: int = 40, depth: int = 5, step: float = 0.1, seed: int = 7) -> PipelineModel:
    """Boosted trees on numeric features; `stop` marks rows for early stopping."""
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed, **({"validationIndicatorCol": stop} if stop else {}))
    return _assembled(features, model).fit(rows)


def score(model: PipelineModel, rows: DataFrame, name: str = "prob") -> DataFrame:
    """rows with the probability of class 1."""
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def train_cardinality(rows: DataFrame, features: list[str], label: str = "k", seed: int = 7) -> PipelineModel:
    """A distribution over the number of true matches (0 .. 7)."""
    return _assembled(features, RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=40, maxDepth=8, seed=seed)).fit(rows)


def out_of_fold(rows: DataFrame, features: list[str], key: str = "s1_id", folds: int = 4, **how) -> DataFrame:
    """Every row scored by a model that saw none of its key's rows."""
    fold = rows.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    parts = [score(train_gbt(fold.where(F.col("_fold") != k), features, **how), fold.where(F.col("_fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def calibrate(train: DataFrame, rows: DataFrame, column: str = "prob", label: str = "y") -> DataFrame:
    """rows with the probability replaced by its isotonic calibration, within [0, 1]."""
    model = IsotonicRegression(featuresCol=column, labelCol=label, predictionCol="_iso").fit(train)
    return model.transform(rows).withColumn(column, F.least(F.greatest("_iso", F.lit(0.0)), F.lit(1.0))).drop("_iso")


def stack(train: DataFrame, rows: DataFrame, features: list[str], label: str = "y", c: float = 10.0) -> DataFrame:
    """rows with the probability of a ridge logistic regression on the features."""
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * max(1, train.count())))
    return score(_assembled(features, model).fit(train), rows)


def token_map(pairs: DataFrame, support: int = 3, precision: float = 0.5) -> DataFrame:
    """(src, dst, n, precision) learned from pairs (name, s1_name) of equal length: each source token's most frequent
    counterpart at the same place, ties to the smaller, if frequent and precise enough and not itself."""
    a, b = tokens("name"), tokens("s1_name")
    at = pairs.where(F.size(a) == F.size(b)).select(F.explode(F.arrays_zip(a.alias("src"), b.alias("dst"))).alias("z")).select("z.src", "z.dst")
    n = at.groupBy("src", "dst").agg(F.count("*").alias("n"))
    by = Window.partitionBy("src")
    best = n.withColumns({"total": F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "dst"))}).where("r = 1")
    return best.withColumn("precision", F.col("n") / F.col("total")).where((F.col("n") >= support) & (F.col("precision") >= precision) & (F.col("src") != F.col("dst"))).select("src", "dst", "n", "precision")


def apply_token_map(records: DataFrame, mapping: DataFrame, column: str = "n_core") -> DataFrame:
    """The column with each token replaced by its counterpart, order kept."""
    rows = records.select("entity_id", F.posexplode(tokens(column)).alias("at", "src")).join(mapping.select("src", "dst"), "src", "left")
    new = rows.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("dst", "src").alias("t")))), lambda x: x["t"]), " ").alias("_new"))
    return records.join(new, "entity_id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def save_token_map(mapping: DataFrame, path: str) -> None:
    """A token map as JSON lines, in the shared store."""
    mapping.select("src", "dst").orderBy("src").write.mode("overwrite").json(path)


def load_token_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, dst string").json(path)


def score_stream(model: PipelineModel, rows: DataFrame, floor: float) -> DataFrame:
    """Candidates with a probability of floor or more, an S1's whole list in one partition of the scan's output."""
    return score(model, rows).where(F.col("prob") >= floor).repartition("s1_id")


def hard_negatives(labeled: DataFrame, hardest: int = 6, others: int = 2) -> DataFrame:
    """All positives, each S1's most probable negatives, and a few more in hash order."""
    neg = labeled.where(~F.col("label"))
    by = Window.partitionBy("s1_id")
    ranked = neg.withColumn("r", F.row_number().over(by.orderBy(F.desc("prob"), "cand_id")))
    hard, rest = ranked.where(F.col("r") <= hardest).drop("r"), ranked.where(F.col("r") > hardest).drop("r")
    some = rest.withColumn("r", F.row_number().over(by.orderBy(F.md5("cand_id"), "cand_id"))).where(F.col("r") <= others).drop("r")
    return reduce(DataFrame.unionByName, [labeled.where("label"), hard, some])


def cross_fit_merge(scores: DataFrame) -> DataFrame:
    """One score of two cross-fitted models: rows of half 0 by model 1, of half 1 by model 0, of neither by the mean."""
    return scores.withColumn("score", F.when(F.col("cf") == 0, F.col("l1")).when(F.col("cf") == 1, F.col("l0")).otherwise((F.col("l0") + F.col("l1")) / 2))


def roles(s1: DataFrame, stop_share: float = 0.1, seed: int = 3) -> DataFrame:
    """s1_id and role: train or early stopping, by hash."""
    return s1.withColumn("role", F.when(uniform(F.col("s1_id"), F.lit(seed)) < stop_share, "es").otherwise("train"))


def placeholder(pairs: DataFrame) -> DataFrame:
    """The minimum scorer: 0.7 name similarity by edits and 0.3 for an equal house number."""
    a, b = F.coalesce("n_core", F.lit("")), F.coalesce("n_core_c", F.lit(""))
    name = 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    house = ((F.col("a_house") == F.col("a_house_c")) & (F.col("a_house") != "")).cast("double")
    return pairs.withColumn("prob", F.round(0.7 * name + 0.3 * F.coalesce(house, F.lit(0.0)), 6))
