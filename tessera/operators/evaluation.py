"""Evaluation programs: one report for every run, leave-one-country-out, adversarial validation, frozen thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import udf
from tessera.functions.text import token_set
from tessera.functions.hashing import md5_unit
from tessera.operators import decision, metrics, models


def log_predictions(preds: DataFrame, truth: DataFrame, spine: DataFrame, t: float | None = None) -> DataFrame:
    """The same one-row report for every run: assignment, threshold (tuned unless given), scores."""
    assigned = decision.assign_best(preds.join(spine, "s1_id", "left_semi"))
    if t is None:
        t = decision.tune_threshold(assigned, truth, spine.select("s1_id")).first().t
    scores = metrics.entity_scores(decision.threshold(assigned, t), truth, spine.select("s1_id"))
    return metrics.report(scores).withColumn("t", F.lit(float(t)))


def confirm(base: DataFrame, last: DataFrame, truth: DataFrame, spine: DataFrame, t: float, n: int = 1000) -> DataFrame:
    """A frozen threshold on held-out S1: the paired bootstrap of the last predictions against the base."""
    a, b = (metrics.entity_scores(decision.threshold(decision.assign_best(p), t), truth, spine) for p in (base, last))
    return metrics.paired_bootstrap(a, b, n)


def loco(rows: DataFrame, features: list[str], truth: DataFrame, spine: DataFrame, countries: list[str], **how) -> DataFrame:
    """(trained_on, tested_on, t_source, f_source, t_target, f_target): models of one country scored on each country, at
    the threshold tuned on the training country and at the one tuned on the tested country. A country whose rows do not
    have both labels trains no model: its cells are there, with nulls."""
    out = []
    both = {r.country for r in rows.groupBy("country").agg(F.countDistinct("label").alias("n")).where("n = 2").collect()}
    for a in countries:
        if a not in both:
            out += [(a, b, None, None, None, None) for b in countries]
            continue
        model = models.train_gbt(rows.where(F.col("country") == a), features, **how)
        curves = {}
        for b in countries:
            assigned = decision.assign_best(models.score(model, rows.where(F.col("country") == b)).select("s1_id", "cand_id", "prob"))
            curves[b] = {r.t: r.macro for r in decision.threshold_curve(assigned, truth, spine.where(F.col("country") == b).select("s1_id")).collect()}
        best = {b: min(c, key=lambda t: (-round(c[t], 9), t)) for b, c in curves.items()}
        out += [(a, b, best[a], curves[b][best[a]], best[b], curves[b][best[b]]) for b in countries]
    return rows.sparkSession.createDataFrame(out, "trained_on string, tested_on string, t_source double, f_source double, t_target double, f_target double")


def adversarial_auc(a: DataFrame, b: DataFrame, features: list[str], folds: int = 3, **how) -> float:
    """Area under the curve of a model that tells rows of a from rows of b, each row scored out of its fold."""
    rows = a.select("s1_id", *features, F.lit(0.0).alias("y")).unionByName(b.select("s1_id", *features, F.lit(1.0).alias("y")))
    scored = models.out_of_fold(rows, features, folds=folds, **how)
    return BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="y").evaluate(scored)


def feature_quantiles(rows: DataFrame, features: list[str], at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(feature, q): exact quantiles of each feature, null and NaN aside."""
    cells = [F.struct(F.lit(f).alias("feature"), F.expr(f"percentile(CASE WHEN NOT isnan({f}) THEN {f} END, array({', '.join(map(str, at))}))").alias("q")) for f in features]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def templated_streets(pairs: DataFrame, s1: DataFrame, share: float = 0.003, least: float = 50.0) -> DataFrame:
    """Pairs whose streets differ in their significant words: those that are no numbers and stand in no more than
    `share` of the S1 streets of the pair's country. Token-set similarity below `least`; words of neither side count as alike."""
    words = s1.select("country", F.explode(token_set("a_street")).alias("w")).groupBy("country", "w").agg(F.count("*").alias("n"))
    total = s1.groupBy("country").agg(F.count("*").alias("total"))
    common = words.join(total, "country").where(F.col("n") > F.col("total") * share).select("country", "w")

    def significant(side: str, name: str) -> DataFrame:
        w = pairs.select("s1_id", "cand_id", "country", F.posexplode(token_set(side)).alias("at", "w")).where(~F.col("w").rlike("^[0-9]+$")).join(common, ["country", "w"], "left_anti")
        return w.groupBy("s1_id", "cand_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias(name))

    both = pairs.select("s1_id", "cand_id").join(significant("a_street", "x"), ["s1_id", "cand_id"]).join(significant("a_street_c", "y"), ["s1_id", "cand_id"])
    return both.withColumn("street_sim", udf("token_set_ratio")("x", "y")).where(F.col("street_sim") < least)


def view_mixture(rows: DataFrame, views: dict[int, DataFrame], k: int = 6) -> DataFrame:
    """Training rows from several pruned views of the same pairs: each S1's rows come from the view that md5 mod k of its
    id names; ids whose number has no view keep the base rows."""
    part = F.floor(md5_unit(F.col("s1_id"), "view") * k).cast("int")
    base = rows.where(~part.isin(list(views)))
    return reduce(DataFrame.unionByName, [v.where(part == n) for n, v in views.items()], base)
