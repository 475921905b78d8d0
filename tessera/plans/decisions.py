"""Queries on predictions: the minimum slice, decisions, scores, audits, robustness, learned parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, decision, evaluation, features, metrics, models, robust
from tessera.plans.records import RBITS, UNIT, unioned
from tessera.plans.registry import query
from tessera.plans.views import PAIRS, RECORDS, SCORES, Views, f05_sql, key, tok
from tessera.sources import tables

WP = f"WITH {PAIRS}"
WS = f"WITH {SCORES}"


def scores(v: Views):
    return metrics.entity_scores(v.matches, v.truth, v.spine)


@query("n13_minimum_slice", "s1_id:s match_id:s", f"{WP} SELECT s1_id, cand_id AS match_id FROM assigned WHERE prob >= 0.5")
def n13(spark, d):
    """Blocking, placeholder score, assignment and threshold end to end."""
    return Views(spark, d).matches


@query("j1_assign", "s1_id:s cand_id:s prob:d margin:d", f"{WP} SELECT s1_id, cand_id, prob, margin FROM assigned")
def j1(spark, d):
    return Views(spark, d).assigned


CURVE = f"""grid AS (SELECT round(0.05 + 0.025 * i, 6) AS t FROM range(37) r(i)),
cells AS (SELECT g.t, n.s1_id, n.n_true, count(a.cand_id) AS p, count(x.match_id) AS tp FROM grid g CROSS JOIN ntrue n LEFT JOIN assigned a ON a.s1_id = n.s1_id AND a.prob >= g.t LEFT JOIN truth x ON x.s1_id = a.s1_id AND x.match_id = a.cand_id GROUP BY ALL),
curve AS (SELECT t, avg({f05_sql('tp', 'n_true', 'p')}) AS macro FROM cells GROUP BY t)"""


@query("j3_threshold_curve", "t:d macro:d", f"{WP}, {CURVE} SELECT t, macro FROM curve")
def j3(spark, d):
    v = Views(spark, d)
    return decision.threshold_curve(v.assigned, v.truth, v.spine)


@query("j3_tune", "t:d macro:d", f"{WP}, {CURVE} SELECT t, round(macro, 9) AS macro FROM curve ORDER BY 2 DESC, 1 LIMIT 1")
def j3_tune(spark, d):
    v = Views(spark, d)
    return decision.tune_threshold(v.assigned, v.truth, v.spine)


@query("j5_expected_f05", "s1_id:s cand_id:s k:i expected:d")
def j5(spark, d):
    return decision.expected_f05_matches(Views(spark, d).assigned)


def _flagged(v: Views):
    from tessera.operators.context import keyed_pairs

    sim = 100 * (1 - F.levenshtein("n_core", "n_core_c") / F.greatest(F.char_length("n_core"), F.char_length("n_core_c"), F.lit(1)))
    pairs = keyed_pairs(v.pairs).join(v.assigned.select("s1_id", "cand_id", "prob"), ["s1_id", "cand_id"])
    return decision.rule_flags(pairs, v.s1, sim)


RULES = f"""sk AS (SELECT country, {key('n_core')} AS n_key, {key('a_full')} AS a_key FROM s1),
fl AS (SELECT n.s1_id, n.cand_id, a.prob, n.a_empty_c, {key('n.n_core')} AS nk, {key('n.n_core_c')} AS nkc, {key('n.a_full')} AS ak, {key('n.a_full_c')} AS akc, n.name_sim, n.country_c FROM near n JOIN assigned a ON a.s1_id = n.s1_id AND a.cand_id = n.cand_id),
fc AS (SELECT *, (SELECT count(*) FROM sk WHERE sk.country = fl.country_c AND sk.n_key = fl.nkc AND sk.n_key <> '') AS cn, (SELECT count(*) FROM sk WHERE sk.country = fl.country_c AND sk.a_key = fl.akc AND sk.a_key <> '') AS ca FROM fl),
fr AS (SELECT s1_id, cand_id, prob, a_empty_c AND nk = nkc AND nk <> '' AND cn = 1 AS rule_a, a_empty_c AND cn >= 2 AS drop_a, ak = akc AND ak <> '' AND ca = 1 AND name_sim < 50 AS rule_b FROM fc)"""


@query("j6_postrules", "s1_id:s cand_id:s rule_a:b drop_a:b rule_b:b keep:b", f"{WP}, {RULES} SELECT s1_id, cand_id, rule_a, drop_a, rule_b, (prob >= 0.5 OR rule_a OR rule_b) AND NOT (prob >= 0.5 AND drop_a) AS keep FROM fr")
def j6(spark, d):
    return _flagged(Views(spark, d)).withColumn("keep", decision.keep(0.5))


RANKS = "rk AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS k, CAST(substr(cand_id, 2, 1) AS INT) AS src FROM assigned)"


@query("j7_profile", "s1_id:s p1:d p2:d p10:d gap1:d n_assigned:i p_sum:d n_ge50:i n_ge90:i s2_ge50:i s3_ge50:i s3_max:d log_p_none:d", f"""{WP}, {RANKS}, g AS (SELECT s.s1_id, coalesce(max(CASE WHEN k = 1 THEN prob END), 0) AS p1, coalesce(max(CASE WHEN k = 2 THEN prob END), 0) AS p2, coalesce(max(CASE WHEN k = 10 THEN prob END), 0) AS p10, count(prob) AS n_assigned, coalesce(sum(prob), 0) AS p_sum, count(CASE WHEN prob >= 0.5 THEN 1 END) AS n_ge50, count(CASE WHEN prob >= 0.9 THEN 1 END) AS n_ge90,
 count(CASE WHEN src = 2 AND prob >= 0.5 THEN 1 END) AS s2_ge50, count(CASE WHEN src = 3 AND prob >= 0.5 THEN 1 END) AS s3_ge50, coalesce(max(CASE WHEN src = 3 THEN prob END), 0) AS s3_max, coalesce(sum(CASE WHEN k <= 10 THEN ln(least(greatest(1 - prob, 1e-6), 1.0)) END), 0) AS log_p_none FROM spine s LEFT JOIN rk ON rk.s1_id = s.s1_id GROUP BY s.s1_id)
SELECT *, p1 - p2 AS gap1 FROM g""")
def j7(spark, d):
    v = Views(spark, d)
    return decision.profile(v.assigned, v.spine)


PREFIX = f"""{RANKS}, pf AS (SELECT n.s1_id, c.k, c.tp, n.n_true FROM ntrue n JOIN (SELECT s1_id, 0 AS k, 0 AS tp FROM spine UNION ALL SELECT s1_id, k, tp FROM (SELECT rk.s1_id, rk.k, sum(CAST(t.match_id IS NOT NULL AS INT)) OVER (PARTITION BY rk.s1_id ORDER BY rk.k ROWS UNBOUNDED PRECEDING) AS tp FROM rk LEFT JOIN truth t ON t.s1_id = rk.s1_id AND t.match_id = rk.cand_id) WHERE k <= 10) c ON c.s1_id = n.s1_id),
pk AS (SELECT s1_id, k, {f05_sql('tp', 'n_true', 'k')} AS f FROM pf)"""


@query("j8_prefix_f", "s1_id:s k:i f:d", f"{WP}, {PREFIX} SELECT s1_id, k, f FROM pk")
def j8_prefix(spark, d):
    v = Views(spark, d)
    return decision.prefix_scores(v.assigned, v.truth, v.spine)


@query("j8_oracle_k", "s1_id:s k:i f:d", f"{WP}, {PREFIX} SELECT s1_id, k, f FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(f, 12) DESC, k) AS r FROM pk) WHERE r = 1")
def j8(spark, d):
    v = Views(spark, d)
    return decision.oracle_k(v.assigned, v.truth, v.spine)


@query("j10_topk_matches", "s1_id:s match_id:s", f"{WP}, {RANKS}, kk AS (SELECT s1_id, CAST(substr(s1_id, 4) AS INT) // 3 % 3 AS n FROM spine) SELECT rk.s1_id, rk.cand_id AS match_id FROM rk JOIN kk ON kk.s1_id = rk.s1_id WHERE rk.k <= kk.n AND rk.prob >= 0.2")
def j10(spark, d):
    v = Views(spark, d)
    return decision.top_k_matches(v.assigned, v.spine.withColumn("k", F.expr("cast(substring(s1_id, 4) as int) div 3 % 3")), 0.2)


@query("j11_relative", "s1_id:s cand_id:s r_rank:i r_pmax:d r_n:i r_n_ge50:i r_prev_gap:d r_next_gap:d r_mass_above:d r_rank_src:i r_ratio:d", f"""{WP}, {RANKS} SELECT s1_id, cand_id, k - 1 AS r_rank, max(prob) OVER g AS r_pmax, count(*) OVER g AS r_n, sum(CAST(prob >= 0.5 AS INT)) OVER g AS r_n_ge50, coalesce(lag(prob) OVER o - prob, 0) AS r_prev_gap, coalesce(prob - lead(prob) OVER o, prob) AS r_next_gap, coalesce(sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r_mass_above,
 row_number() OVER (PARTITION BY s1_id, src ORDER BY prob DESC, cand_id) AS r_rank_src, prob / greatest(max(prob) OVER g, 1e-6) AS r_ratio FROM rk WINDOW g AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY prob DESC, cand_id)""")
def j11(spark, d):
    return decision.relative_features(Views(spark, d).assigned)


@query("j12_owned", "s1_id:s match_id:s", f"{WP} SELECT p.s1_id, p.cand_id AS match_id FROM preds p JOIN assigned a ON a.s1_id = p.s1_id AND a.cand_id = p.cand_id WHERE p.prob >= 0.3")
def j12(spark, d):
    v = Views(spark, d)
    return decision.owned(v.preds.where("prob >= 0.3").select("s1_id", F.col("cand_id").alias("match_id")), v.preds)


@query("j14_per_source_grid", "t2:d t3:d macro:d", f"""{WP}, g AS (SELECT i / 10.0 AS t FROM range(1, 10) r(i)), c AS (SELECT a.t AS t2, b.t AS t3, n.s1_id, n.n_true, count(x.cand_id) AS p, count(t.match_id) AS tp FROM g a CROSS JOIN g b CROSS JOIN ntrue n LEFT JOIN assigned x ON x.s1_id = n.s1_id AND x.prob >= CASE substr(x.cand_id, 2, 1) WHEN '2' THEN a.t ELSE b.t END LEFT JOIN truth t ON t.s1_id = x.s1_id AND t.match_id = x.cand_id GROUP BY ALL)
SELECT t2, t3, avg({f05_sql('tp', 'n_true', 'p')}) AS macro FROM c GROUP BY ALL""")
def j14(spark, d):
    v = Views(spark, d)
    return decision.per_source_grid(v.assigned, v.truth, v.spine)


@query("j15_band_stack", "s1_id:s cand_id:s prob:d", f"{WP} SELECT a.s1_id, a.cand_id, CASE WHEN a.prob > 0.05 AND a.prob < 0.98 THEN 1 / (1 + exp(-(0.5 + ln(a.prob / (1 - a.prob)) - 0.25 * n.addr_sim / 100))) ELSE a.prob END AS prob FROM assigned a JOIN near n ON n.s1_id = a.s1_id AND n.cand_id = a.cand_id")
def j15(spark, d):
    v = Views(spark, d)
    other = v.pairs.select("s1_id", "cand_id", (F.col("addr_sim") / 100).alias("xenc"))
    return decision.band_stack(v.assigned.join(other, ["s1_id", "cand_id"]), coef=(0.5, 1.0, -0.25))


COMPARED = """named AS (SELECT 'thr' AS rule, 'tuned' AS params, s1_id, cand_id FROM assigned WHERE prob >= (SELECT t FROM curve ORDER BY round(macro, 9) DESC, t LIMIT 1) UNION ALL SELECT 'thr', 'frozen', s1_id, cand_id FROM assigned WHERE prob >= 0.5
 UNION ALL SELECT 's2_thr', 'frozen', s1_id, cand_id FROM assigned WHERE prob >= CASE substr(cand_id, 2, 1) WHEN '2' THEN 0.6 ELSE 0.4 END)"""


@query("j13_rules", "rule:s params:s macro:d", f"""{WP}, {CURVE}, {COMPARED}, rp AS (SELECT DISTINCT rule, params FROM (VALUES ('thr', 'tuned'), ('thr', 'frozen'), ('s2_thr', 'frozen')) v(rule, params)),
hit AS (SELECT rp.rule, rp.params, n.s1_id, n.n_true, count(d.cand_id) AS p, count(t.match_id) AS tp FROM rp CROSS JOIN ntrue n LEFT JOIN named d ON d.rule = rp.rule AND d.params = rp.params AND d.s1_id = n.s1_id LEFT JOIN truth t ON t.s1_id = d.s1_id AND t.match_id = d.cand_id GROUP BY ALL)
SELECT rule, params, avg({f05_sql('tp', 'n_true', 'p')}) AS macro FROM hit GROUP BY ALL""")
def j13(spark, d):
    """One threshold, tuned and frozen, and one for each source."""
    v = Views(spark, d)
    best = decision.tune_threshold(v.assigned, v.truth, v.spine).first().t
    by_source = F.when(F.substring("cand_id", 2, 1) == "2", 0.6).otherwise(0.4)
    frozen = {"thr": v.matches, "s2_thr": decision.threshold(v.assigned, by_source)}
    return decision.compare_rules({"thr": decision.threshold(v.assigned, best)}, frozen, v.truth, v.spine)


@query("a25_splice", "s1_id:s cand_id:s prob:d", f"{WP} SELECT s1_id, cand_id, prob FROM assigned WHERE s1_id NOT IN (SELECT s1_id FROM spine WHERE country = 'fr') UNION ALL SELECT s1_id, cand_id, prob FROM preds WHERE s1_id IN (SELECT s1_id FROM spine WHERE country = 'fr')")
def a25(spark, d):
    v = Views(spark, d)
    return decision.splice(v.assigned.select("s1_id", "cand_id", "prob"), v.preds, v.spine.where("country = 'fr'").select("s1_id"))


@query("m1_entity_f05", "s1_id:s n_true:i n_pred:i tp:i fp:i fn:i f05:d", f"{WS} SELECT s1_id, n_true, n_pred, tp, fp, fn, f05 FROM scores")
def m1(spark, d):
    return scores(Views(spark, d))


@query("m2_report", "n:i macro_f05:d pair_precision:d pair_recall:d singleton_rate:d singleton_acc:d entities_with_fp:i avg_pred:d", f"""{WS} SELECT count(*) AS n, avg(f05) AS macro_f05, coalesce(sum(tp) / CAST(nullif(sum(n_pred), 0) AS DOUBLE), 1) AS pair_precision, coalesce(sum(tp) / CAST(nullif(sum(n_true), 0) AS DOUBLE), 1) AS pair_recall, avg(CAST(n_true = 0 AS INT)) AS singleton_rate, avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS INT) END) AS singleton_acc, sum(CAST(fp > 0 AS INT)) AS entities_with_fp, avg(n_pred) AS avg_pred FROM scores""")
def m2(spark, d):
    return metrics.report(scores(Views(spark, d)))


@query("m2_by_country", "country:s n:i f05:d", f"{WS} SELECT country, count(*) AS n, avg(f05) AS f05 FROM scores GROUP BY ALL")
def m2_country(spark, d):
    return metrics.report_by(scores(Views(spark, d)), "country")


@query("m2_by_true_count", "n_true_capped:i n:i f05:d", f"{WS} SELECT least(n_true, 6) AS n_true_capped, count(*) AS n, avg(f05) AS f05 FROM scores GROUP BY ALL")
def m2_count(spark, d):
    return metrics.by_true_count(scores(Views(spark, d)))


@query("m4_bootstrap", "delta:d low:d high:d p_not_better:d")
def m4(spark, d):
    v = Views(spark, d)
    return metrics.paired_bootstrap(metrics.entity_scores(decision.threshold(v.assigned, 0.8), v.truth, v.spine), scores(v), 200)


@query("m5_blocking_report", "pair_recall:d full_coverage:d mean_candidates:d p50_candidates:d p95_candidates:d max_candidates:i empty_rate:d reduction_ratio:d", f"""{WP}, c AS (SELECT n.s1_id, n.n_true, (SELECT count(*) FROM pairs p WHERE p.s1_id = n.s1_id) AS c, (SELECT count(*) FROM truth t JOIN pairs p ON p.s1_id = t.s1_id AND p.cand_id = t.match_id WHERE t.s1_id = n.s1_id) AS f FROM ntrue n)
SELECT sum(f) / CAST(sum(n_true) AS DOUBLE) AS pair_recall, avg(CASE WHEN n_true > 0 THEN CAST(f = n_true AS INT) END) AS full_coverage, avg(c) AS mean_candidates, quantile_cont(c, 0.5) AS p50_candidates, quantile_cont(c, 0.95) AS p95_candidates, max(c) AS max_candidates, avg(CAST(c = 0 AS INT)) AS empty_rate, 1 - sum(c) / CAST(count(*) * (SELECT count(*) FROM pool) AS DOUBLE) AS reduction_ratio FROM c""")
def m5(spark, d):
    v = Views(spark, d)
    return metrics.blocking_report(v.candidates, v.truth, v.spine, v.pool.count())


@query("m5_recall_by_country", "country:s n_true:i recall:d", f"{WP} SELECT s.country, count(*) AS n_true, count(p.cand_id) / CAST(count(*) AS DOUBLE) AS recall FROM truth t JOIN spine s ON s.s1_id = t.s1_id LEFT JOIN pairs p ON p.s1_id = t.s1_id AND p.cand_id = t.match_id GROUP BY ALL")
def m5_country(spark, d):
    v = Views(spark, d)
    return metrics.recall_by_country(v.candidates, v.truth, v.spine)


@query("m6_recall_at_cap", "cap:i recall:d", f"{WP}, r AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM preds) SELECT c.cap, avg(CAST(coalesce(r.r, 999999) <= c.cap AS INT)) AS recall FROM truth t LEFT JOIN r ON r.s1_id = t.s1_id AND r.cand_id = t.match_id CROSS JOIN (VALUES (1), (2), (4)) c(cap) GROUP BY ALL")
def m6_cap(spark, d):
    v = Views(spark, d)
    return metrics.recall_at(v.preds, v.truth, "prob", (1, 2, 4))


BUCKETS = """CASE WHEN n_script_c <> 'latin' THEN 'native_script' WHEN n_kind_c = 'empty' THEN 'empty_name' WHEN n_kind_c IN ('domain', 'handle') THEN 'domain_handle' WHEN n_alias_c <> '' THEN 'alias' WHEN name_sim >= 90 THEN 'name_near_identical' WHEN name_sim >= 70 AND name_sim < 80 THEN 'name_extra_or_reorder' WHEN name_sim >= 60 THEN 'name_typo_moderate' ELSE 'name_heavy_diff' END AS bucket,
CASE WHEN a_empty_c THEN 'cand_addr_empty' WHEN a_house_c = '' THEN 'cand_no_house' WHEN a_house = a_house_c THEN 'house_equal' WHEN ltrim(a_house, '0') = ltrim(a_house_c, '0') THEN 'house_zero_pad' ELSE 'house_diff' END AS addr_state"""
STATES = ["cand_addr_empty", "cand_no_house", "house_equal", "house_zero_pad", "house_diff"]


ADDRESS_BITS = blocking.RBITS["akey"] | blocking.RBITS["hskey"]


def _missed(v: Views):
    """Pairs of truth that the address retrievers do not find, with the edit similarities of their names."""
    cands = unioned(v).where(F.col("rbits").bitwiseAND(ADDRESS_BITS) != 0).select("s1_id", "cand_id")
    missed = v.truth.withColumnRenamed("match_id", "cand_id").join(cands, ["s1_id", "cand_id"], "left_anti")
    sim = 100 * (1 - F.levenshtein("n_core", "n_core_c") / F.greatest(F.char_length("n_core"), F.char_length("n_core_c"), F.lit(1)))
    return features.attach(missed, v.s1, v.pool).withColumns({"name_tset": sim, "name_ratio": sim})


SIDES = ", ".join(f"s.{c} AS {c}, p.{c} AS {c}_c" for c in ("n_core", "n_kind", "n_script", "n_alias", "a_house", "a_empty"))
MISSED = f"{RBITS}, mi AS (SELECT t.s1_id, t.match_id AS cand_id, {SIDES}, 100 * (1 - levenshtein(s.n_core, p.n_core) / CAST(greatest(length(s.n_core), length(p.n_core), 1) AS DOUBLE)) AS name_sim FROM truth t JOIN s1 s ON s.entity_id = t.s1_id JOIN pool p ON p.entity_id = t.match_id WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.s1_id = t.s1_id AND c.cand_id = t.match_id AND c.rbits & {ADDRESS_BITS} <> 0))"


@query("m7_miss_audit", "bucket:s addr_state:s n:i", f"{WP}, {MISSED} SELECT bucket, addr_state, count(*) AS n FROM (SELECT {BUCKETS} FROM mi) GROUP BY ALL")
def m7(spark, d):
    return metrics.miss_audit(_missed(Views(spark, d)))


@query("m7_audit_pivot", "bucket:s " + " ".join(f"{s}:i" for s in STATES) + " total:i", f"{WP}, {MISSED} SELECT bucket, {', '.join(f'count(CASE WHEN addr_state = {chr(39)}{s}{chr(39)} THEN 1 END) AS {s}' for s in STATES)}, count(*) AS total FROM (SELECT {BUCKETS} FROM mi) GROUP BY bucket")
def m7_pivot(spark, d):
    return metrics.pivoted(metrics.miss_audit(_missed(Views(spark, d))), "bucket", "addr_state", STATES)


@query("m9_dm_entity", "s1_id:s tp:i fp:i fn:i f05:d", f"""{WP}, l AS (SELECT a.s1_id, a.prob, t.match_id IS NOT NULL AS lab, CASE WHEN t.match_id IS NULL AND a.prob BETWEEN 0.05 AND 0.98 THEN 3 ELSE 1 END AS c FROM assigned a LEFT JOIN truth t ON t.s1_id = a.s1_id AND t.match_id = a.cand_id),
g AS (SELECT n.s1_id, n.n_true, coalesce(sum(CAST(prob >= 0.5 AND lab AS INT)), 0) AS tp, coalesce(sum(CASE WHEN prob >= 0.5 AND NOT lab THEN c ELSE 0 END), 0) AS fp FROM ntrue n LEFT JOIN l ON l.s1_id = n.s1_id GROUP BY ALL)
SELECT s1_id, tp, fp, n_true - tp AS fn, CASE WHEN 1.25 * tp + 0.25 * (n_true - tp) + fp = 0 THEN 1 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + fp) END AS f05 FROM g""")
def m9(spark, d):
    from tessera.operators.features import label

    v = Views(spark, d)
    spine = v.spine.join(v.truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").na.fill(0)
    return robust.dm_entity_f05(robust.copies(label(v.assigned, v.truth), 3.0), spine, 0.5)


TWIN = f"""tk AS (SELECT entity_id, country, {key('n_core')} AS n_key, {key('a_full')} AS a_key, ltrim(a_house, '0') AS house FROM s1),
tw AS (SELECT entity_id, (a_key <> '' AND (SELECT count(*) FROM tk b WHERE b.country = tk.country AND b.a_key = tk.a_key) > 1) OR (n_key <> '' AND (SELECT count(*) FROM tk b WHERE b.country = tk.country AND b.n_key = tk.n_key) > 1) AS shared, n_key <> '' AND (SELECT count(DISTINCT b.house) FROM tk b WHERE b.country = tk.country AND b.n_key = tk.n_key) > 1 AS twin FROM tk)"""


@query("m10_twin_flag", "entity_id:s shared:b twin:b", f"WITH {RECORDS}, {TWIN} SELECT entity_id, shared, twin FROM tw")
def m10_twin(spark, d):
    return robust.twin_flag(Views(spark, d).s1)


@query("m10_removal_mask", "entity_id:s removed:b", f"WITH {RECORDS}, {TWIN}, wt AS (SELECT entity_id, CASE WHEN shared THEN 2.0 ELSE 0.5 END AS w FROM tw) SELECT entity_id, {UNIT.format('entity_id')} < least(1.0, 0.19 * w / (SELECT avg(w) FROM wt)) AS removed FROM wt")
def m10(spark, d):
    return robust.removal_mask(Views(spark, d).s1, 0.19, "biased")


@query("m11_loss_split", "loss:d fp_singleton:d fp_other:d fn:d", f"""{WS} SELECT avg(1 - f05) AS loss, avg(CASE WHEN n_true = 0 THEN 1 - f05 ELSE 0 END) AS fp_singleton, avg(CASE WHEN n_true > 0 THEN c - f05 ELSE 0 END) AS fp_other, avg(CASE WHEN n_true > 0 THEN 1 - c ELSE 0 END) AS fn FROM (SELECT *, {f05_sql('tp', 'n_true', 'tp')} AS c FROM scores)""")
def m11(spark, d):
    return robust.loss_decomposition(scores(Views(spark, d)))


@query("m11_fp_sources", "owner:s n:i", f"WITH {SCORES}, rm AS (SELECT entity_id, {UNIT.format('entity_id')} < 0.3 AS removed FROM s1) SELECT CASE WHEN o.s1_id IS NULL THEN 'none' WHEN rm.removed THEN 'removed' ELSE 'other' END AS owner, count(*) AS n FROM pred p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.match_id = p.match_id LEFT JOIN truth o ON o.match_id = p.match_id LEFT JOIN rm ON rm.entity_id = o.s1_id WHERE t.s1_id IS NULL GROUP BY ALL")
def m11_fp(spark, d):
    v = Views(spark, d)
    return robust.fp_sources(v.matches, v.truth, robust.removal_mask(v.s1, 0.3))


@query("m12_orphan_simulation", "s1_id:s n_true:i n_pred:i tp:i f05:d", f"""{WP}, lf AS (SELECT s1_id FROM spine WHERE NOT {UNIT.format('s1_id')} < 0.3), p2 AS (SELECT p.* FROM preds p JOIN lf ON lf.s1_id = p.s1_id), r2 AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS r FROM p2), h2 AS (SELECT r2.s1_id, count(*) AS n_pred, count(t.match_id) AS tp FROM r2 LEFT JOIN truth t ON t.s1_id = r2.s1_id AND t.match_id = r2.cand_id WHERE r2.r = 1 AND r2.prob >= 0.5 GROUP BY ALL)
SELECT lf.s1_id, n.n_true, coalesce(h2.n_pred, 0) AS n_pred, coalesce(h2.tp, 0) AS tp, {f05_sql('coalesce(h2.tp, 0)', 'n.n_true', 'coalesce(h2.n_pred, 0)')} AS f05 FROM lf JOIN ntrue n ON n.s1_id = lf.s1_id LEFT JOIN h2 ON h2.s1_id = lf.s1_id""")
def m12(spark, d):
    v = Views(spark, d)
    left, preds = robust.simulate(v.s1, v.preds, 0.3, "uniform")
    spine = left.select(F.col("entity_id").alias("s1_id"))
    return metrics.entity_scores(decision.threshold(decision.assign_best(preds), 0.5), v.truth.join(spine, "s1_id", "left_semi"), spine)


SCENARIOS = f"""scen(scenario, rate, variant, thin) AS (VALUES {", ".join(f"('{n}', {r}, '{v}', {str(t).lower()})" for n, (r, v, t) in robust.SCENARIOS.items())}),
wt AS (SELECT entity_id, twin, CASE WHEN shared THEN 2.0 ELSE 0.5 END AS w, {UNIT.format("entity_id")} AS u, {UNIT.format("entity_id").replace("orphan", "thin")} AS ut FROM tw),
lf AS (SELECT c.scenario, s.entity_id AS s1_id, s.country, {key("s.n_core")} AS n_key FROM scen c CROSS JOIN wt JOIN s1 s ON s.entity_id = wt.entity_id
 WHERE NOT (c.thin AND ut >= 0.8) AND NOT CASE c.variant WHEN 'uniform' THEN u < rate WHEN 'twin' THEN twin AND u < rate ELSE u < least(1.0, rate * w / (SELECT avg(w) FROM wt)) END),
gr AS (SELECT c.scenario, p.entity_id FROM scen c CROSS JOIN pool p LEFT JOIN truth t ON t.match_id = p.entity_id LEFT JOIN wt ON wt.entity_id = t.s1_id WHERE c.thin AND CASE WHEN t.s1_id IS NULL THEN {UNIT.format("p.entity_id").replace("orphan", "thin")} >= 0.8 ELSE wt.ut >= 0.8 END),
nk AS (SELECT scenario, country, n_key, count(*) AS c FROM lf GROUP BY ALL),
pp AS (SELECT lf.scenario, p.s1_id, p.cand_id, round(p.prob * CASE WHEN nk.c > 1 THEN 0.9 ELSE 1.0 END, 6) AS prob FROM preds p JOIN pool o ON o.entity_id = p.cand_id JOIN lf ON lf.s1_id = p.s1_id LEFT JOIN nk ON nk.scenario = lf.scenario AND nk.country = o.country AND nk.n_key = {key("o.n_core")} WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.scenario = lf.scenario AND gr.entity_id = p.cand_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY scenario, cand_id ORDER BY prob DESC, s1_id) AS r FROM pp),
hh AS (SELECT rr.scenario, rr.s1_id, count(*) AS n_pred, count(t.match_id) AS tp FROM rr LEFT JOIN truth t ON t.s1_id = rr.s1_id AND t.match_id = rr.cand_id WHERE rr.r = 1 AND rr.prob >= 0.5 GROUP BY ALL),
ss AS (SELECT lf.scenario, {f05_sql("coalesce(hh.tp, 0)", "n.n_true", "coalesce(hh.n_pred, 0)")} AS f05 FROM lf JOIN ntrue n ON n.s1_id = lf.s1_id LEFT JOIN hh ON hh.scenario = lf.scenario AND hh.s1_id = lf.s1_id),
rec AS (SELECT c.scenario, (SELECT count(*) FROM pool) - (SELECT count(*) FROM gr WHERE gr.scenario = c.scenario) AS records FROM scen c)"""


@query("m12_scenarios", "scenario:s n:i records:i macro_f05:d", f"{WP}, {TWIN}, {SCENARIOS} SELECT ss.scenario, count(*) AS n, any_value(rec.records) AS records, avg(f05) AS macro_f05 FROM ss JOIN rec ON rec.scenario = ss.scenario GROUP BY ss.scenario")
def m12_scenarios(spark, d):
    """All nine removals; a record's score falls where several surviving S1 have its name, which is counted again."""
    v = Views(spark, d)
    n_key = text.sorted_key("n_core")
    base = v.preds.join(v.pool.select(F.col("entity_id").alias("cand_id"), "country", n_key.alias("n_key")), "cand_id").persist()
    keep = v.spine.select("country", F.lit(0.8).alias("keep")).distinct()

    def score(s1, pool, pairs):
        names = s1.groupBy("country", n_key.alias("n_key")).agg(F.count("*").alias("c"))
        return pairs.join(names, ["country", "n_key"], "left").select("s1_id", "cand_id", F.round(F.col("prob") * F.when(F.col("c") > 1, 0.9).otherwise(1.0), 6).alias("prob"))

    out = []
    for name, (rate, variant, thin) in robust.SCENARIOS.items():
        s1, pool, preds = robust.scenario(v.s1, v.pool, v.truth, base, score, rate, variant, keep if thin else None)
        spine = s1.select(F.col("entity_id").alias("s1_id"))
        got = metrics.entity_scores(decision.threshold(decision.assign_best(preds), 0.5), v.truth.join(spine, "s1_id", "left_semi"), spine)
        size = pool.agg(F.count("*").alias("records"))
        out.append(got.agg(F.count("*").alias("n"), F.avg("f05").alias("macro_f05")).crossJoin(size).withColumn("scenario", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query("n8_token_map", "src:s dst:s n:i precision:d", f"""{WP}, z AS (SELECT {tok('n_core_c')} AS a, {tok('n_core')} AS b FROM pairs), u AS (SELECT unnest(a) AS src, unnest(b) AS dst FROM z WHERE len(a) = len(b)), c AS (SELECT src, dst, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM c)
SELECT src, dst, n, n / CAST(total AS DOUBLE) AS "precision" FROM r WHERE r = 1 AND n >= 2 AND n / CAST(total AS DOUBLE) >= 0.3 AND src <> dst""")
def n8(spark, d):
    return models.token_map(Views(spark, d).pairs.select(F.col("n_core_c").alias("name"), F.col("n_core").alias("s1_name")), 2, 0.3)


@query("n9_hard_negatives", "s1_id:s cand_id:s prob:d label:b", f"""{WP}, l AS (SELECT p.*, t.match_id IS NOT NULL AS label FROM preds p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.match_id = p.cand_id), n AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM l WHERE NOT label)
SELECT s1_id, cand_id, prob, label FROM l WHERE label UNION ALL SELECT s1_id, cand_id, prob, label FROM n WHERE r <= 2 UNION ALL SELECT s1_id, cand_id, prob, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(cand_id), cand_id) AS q FROM n WHERE r > 2) WHERE q <= 1""")
def n9(spark, d):
    from tessera.operators.features import label

    v = Views(spark, d)
    return models.hard_negatives(label(v.preds, v.truth), 2, 1)


def _numeric(v: Views):
    from tessera.operators.features import label, built_in

    rows = label(built_in(v.pairs), v.truth).withColumn("y", F.col("label").cast("double"))
    return rows.select("s1_id", "cand_id", "label", "y", *FEATURES)


FEATURES = ["name_sim", "addr_sim", "house_rel", "num_jacc", "extra_tok", "missing_tok", "common_tok", "state_rel", "cand_src"]


@query("n1_gbt", "s1_id:s cand_id:s prob:d")
def n1(spark, d):
    """Boosted trees on the built-in features, scored on their own rows."""
    rows = _numeric(Views(spark, d)).persist()
    return models.score(models.train_gbt(rows, FEATURES, rounds=10, depth=3), rows)


@query("n6_isotonic", "s1_id:s cand_id:s prob:d")
def n6(spark, d):
    from tessera.operators.features import label

    v = Views(spark, d)
    rows = label(v.preds, v.truth).withColumn("y", F.col("label").cast("double")).persist()
    return models.calibrate(rows, rows)


@query("n7_stack", "s1_id:s cand_id:s prob:d")
def n7(spark, d):
    rows = _numeric(Views(spark, d)).persist()
    return models.stack(rows, rows, ["name_sim", "addr_sim"])


@query("d1_similarity_sql", "s1_id:s cand_id:s tset:d partial:d")
def d1(spark, d):
    """The similarities as SQL functions."""
    from tessera.functions.similarity import register

    register(spark)
    Views(spark, d).pairs.createOrReplaceTempView("similarity_pairs")
    return spark.sql("SELECT s1_id, cand_id, token_set_ratio(n_core, n_core_c) AS tset, partial_ratio(n_core, n_core_c) AS partial FROM similarity_pairs")


@query("m17_harness", "n:i macro_f05:d pair_precision:d pair_recall:d t:d", f"""{WP}, {CURVE}, best AS (SELECT t FROM curve ORDER BY round(macro, 9) DESC, t LIMIT 1),
h AS (SELECT n.s1_id, n.n_true, count(a.cand_id) AS p, count(x.match_id) AS tp FROM ntrue n LEFT JOIN assigned a ON a.s1_id = n.s1_id AND a.prob >= (SELECT t FROM best) LEFT JOIN truth x ON x.s1_id = a.s1_id AND x.match_id = a.cand_id GROUP BY ALL)
SELECT count(*) AS n, avg({f05_sql('tp', 'n_true', 'p')}) AS macro_f05, coalesce(sum(tp) / CAST(nullif(sum(p), 0) AS DOUBLE), 1) AS pair_precision, coalesce(sum(tp) / CAST(nullif(sum(n_true), 0) AS DOUBLE), 1) AS pair_recall, (SELECT t FROM best) AS t FROM h""")
def m17(spark, d):
    v = Views(spark, d)
    return evaluation.log_predictions(v.preds, v.truth, v.spine)


@query("m13_loco", "trained_on:s tested_on:s t_source:d f_source:d t_target:d f_target:d")
def m13(spark, d):
    v = Views(spark, d)
    rows = _numeric(v).join(v.spine, "s1_id").persist()
    countries = sorted(r.country for r in tables.countries(v.spine).collect() if r.country is not None)
    return evaluation.loco(rows, FEATURES, v.truth, v.spine, countries, rounds=3, depth=2)


@query("m14_adversarial", "auc:d")
def m14(spark, d):
    rows = _numeric(Views(spark, d)).persist()
    auc = evaluation.adversarial_auc(rows.where("cand_src = 0"), rows.where("cand_src = 1"), [f for f in FEATURES if f != "cand_src"], folds=2, rounds=3, depth=2)
    return spark.createDataFrame([(auc,)], "auc double")


@query("m14_quantiles", "feature:s lo:d mid:d", f"{WP} SELECT 'name_sim' AS feature, quantile_cont(name_sim, 0.05) AS lo, quantile_cont(name_sim, 0.5) AS mid FROM near UNION ALL SELECT 'addr_sim', quantile_cont(addr_sim, 0.05), quantile_cont(addr_sim, 0.5) FROM near")
def m14_quantiles(spark, d):
    q = evaluation.feature_quantiles(Views(spark, d).pairs, ["name_sim", "addr_sim"], (0.05, 0.5))
    return q.select("feature", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"))


@query("m15_templated_streets", "s1_id:s cand_id:s street_sim:d")
def m15(spark, d):
    v = Views(spark, d)
    return evaluation.templated_streets(v.pairs, v.s1, 0.02)
