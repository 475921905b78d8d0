"""Queries on candidate pairs: weighted terms, base features, context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import context, features, retrieval, tfidf
from tessera.plans.registry import query
from tessera.plans.views import BASE, PAIRS, RECORDS, Views, key, tok

W = f"WITH {RECORDS}"
WP = f"WITH {PAIRS}"

VIEWS = {"name": ("n_core", 3, 0.05), "addr": ("a_full", None, 0.05)}


def _terms(view: str, expr: str) -> str:
    return f"SELECT entity_id AS id, country, source, '{view}' AS view, unnest({expr}) AS term FROM drec"


#: Character trigrams within words padded by spaces, and whole tokens.
GRAMS = f"flatten(list_transform({tok('n_core')}, lambda x: list_transform(range(1, greatest(length(x) + 1, 2)), lambda i: substr(' ' || x || ' ', i, 3))))"
TERMS = f"""tf AS (SELECT id, country, source, view, term, count(*) AS tf FROM ({_terms("name", GRAMS)} UNION ALL {_terms("addr", tok("a_full"))}) GROUP BY ALL),
sizes AS (SELECT country, count(*) AS n FROM drec GROUP BY ALL),
idf AS (SELECT t.country, t.view, t.term, ln((1 + s.n) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf t JOIN sizes s ON s.country = t.country GROUP BY t.country, t.view, t.term, s.n HAVING count(*) <= s.n * 0.05),
raw AS (SELECT t.id, t.country, t.source, t.view, t.term, (1 + ln(t.tf)) * i.idf AS w FROM tf t JOIN idf i ON i.country = t.country AND i.view = t.view AND i.term = t.term),
vec AS (SELECT id, country, source, view, term, w / sqrt(sum(w * w) OVER (PARTITION BY view, id)) AS w FROM raw),
both_ AS (SELECT id, country, source, view, term, w * sqrt(CASE view WHEN 'name' THEN 0.35 ELSE 0.65 END) AS w FROM vec)"""


def _vectors(v: Views):
    a, b = tfidf.vectors(v.s1, v.pool, VIEWS)
    return a, b, *(tfidf.combine({"name": 0.35, "addr": 0.65}, x) for x in (a, b))


@query("e7_idf", "country:s view:s term:s idf:d", f"{W}, {TERMS} SELECT country, view, term, idf FROM idf")
def e7(spark, d):
    v = Views(spark, d)
    parts = [tfidf.fit_idf(tfidf.counts(v.s1, c, n, g), tfidf.counts(v.pool, c, n, g), tfidf.sizes(v.s1, v.pool), m) for n, (c, g, m) in VIEWS.items()]
    return parts[0].unionByName(parts[1])


@query("e8_weights", "id:s view:s n:i total:d", f"{W}, {TERMS} SELECT id, view, count(*) AS n, sum(w) AS total FROM vec GROUP BY ALL")
def e8(spark, d):
    a, b, *_ = _vectors(Views(spark, d))
    return a.unionByName(b).groupBy("id", "view").agg(F.count("*").alias("n"), F.sum("w").alias("total"))


TOP = "SELECT {q} AS q, {p} AS p, round(sum(a.w * b.w), 6) AS s FROM both_ a JOIN both_ b ON b.country = a.country AND b.view = a.view AND b.term = a.term WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL"


@query("e10_tf_topk", "s1_id:s cand_id:s s:d", f"{W}, {TERMS} SELECT q AS s1_id, p AS cand_id, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM ({TOP.format(q='a.id', p='b.id')}) WHERE s > 0) WHERE r <= 10")
def e10(spark, d):
    _, _, q, p = _vectors(Views(spark, d))
    return tfidf.top_k(q, p, 10)


@query("e12_tf_empty", "s1_id:s cand_id:s s:d", f"{W}, {TERMS} SELECT q AS s1_id, p AS cand_id, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM (SELECT a.id AS q, b.id AS p, round(sum(a.w * b.w), 6) AS s FROM vec a JOIN vec b ON b.country = a.country AND b.view = a.view AND b.term = a.term JOIN pool e ON e.entity_id = b.id AND e.a_empty WHERE a.view = 'name' AND a.source = 1 GROUP BY ALL) WHERE s > 0) WHERE r <= 5")
def e12(spark, d):
    v = Views(spark, d)
    a, b, *_ = _vectors(v)
    nowhere = v.pool.where("a_empty").select(F.col("entity_id").alias("id"))
    return tfidf.top_k(a.where("view = 'name'"), b.where("view = 'name'").join(nowhere, "id", "left_semi"), 5)


@query("e13_rev", "s1_id:s cand_id:s s:d", f"{W}, {TERMS} SELECT q AS s1_id, p AS cand_id, s FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS r FROM ({TOP.format(q='a.id', p='b.id')}) WHERE s > 0) WHERE r <= 3")
def e13(spark, d):
    _, _, q, p = _vectors(Views(spark, d))
    return tfidf.reverse_top_k(q, p, 3)


@query("e14_rowdot", "s1_id:s cand_id:s cos:d", f"{WP}, {TERMS} SELECT p.s1_id, p.cand_id, coalesce(round(sum(a.w * b.w), 6), 0) AS cos FROM pairs p LEFT JOIN both_ a ON a.id = p.s1_id LEFT JOIN both_ b ON b.id = p.cand_id AND b.view = a.view AND b.term = a.term GROUP BY ALL")
def e14(spark, d):
    v = Views(spark, d)
    _, _, q, p = _vectors(v)
    return tfidf.row_dot(v.candidates, q, p)


def _best(name: str, dots: str, k: int, bit: int) -> str:
    """A common table expression of a weighted-term retriever: the k best of each query."""
    return f"{name} AS (SELECT q AS s1_id, p AS cand_id, {bit} AS bit FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM ({dots}) WHERE s > 0) WHERE r <= {k})"


NOWHERE = "SELECT a.id AS q, b.id AS p, round(sum(a.w * b.w), 6) AS s FROM vec a JOIN vec b ON b.country = a.country AND b.view = a.view AND b.term = a.term JOIN pool e ON e.entity_id = b.id AND e.a_empty WHERE a.view = 'name' AND a.source = 1 GROUP BY ALL"
#: Every retriever at its published size, cosines and the cap; max_df is that of TERMS, as one percent of a few hundred records leaves no terms.
RETRIEVED = f"""{BASE}, {TERMS}, {_best("r_na", TOP.format(q="a.id", p="b.id"), 30, 4)}, {_best("r_empty", NOWHERE, 50, 32)},
every AS MATERIALIZED (SELECT s1_id, cand_id, bit_or(bit) AS rbits FROM (SELECT s1_id, cand_id, rbits AS bit FROM base UNION ALL SELECT * FROM r_na UNION ALL SELECT * FROM r_empty) GROUP BY ALL),
c_name AS (SELECT e.s1_id, e.cand_id, round(sum(a.w * b.w), 6) AS c FROM every e JOIN vec a ON a.id = e.s1_id AND a.view = 'name' JOIN vec b ON b.id = e.cand_id AND b.view = 'name' AND b.term = a.term GROUP BY ALL),
c_na AS (SELECT e.s1_id, e.cand_id, round(sum(a.w * b.w), 6) AS c FROM every e JOIN both_ a ON a.id = e.s1_id JOIN both_ b ON b.id = e.cand_id AND b.view = a.view AND b.term = a.term GROUP BY ALL),
cosines AS (SELECT e.s1_id, e.cand_id, e.rbits, coalesce(m.kmask, 0) AS kmask, coalesce(x.c, 0) AS cos_name, coalesce(y.c, 0) AS cos_na, CASE WHEN s.a_empty OR p.a_empty THEN coalesce(x.c, 0) ELSE coalesce(y.c, 0) END AS score
 FROM every e JOIN s1 s ON s.entity_id = e.s1_id JOIN pool p ON p.entity_id = e.cand_id LEFT JOIN b_keys m ON m.s1_id = e.s1_id AND m.cand_id = e.cand_id LEFT JOIN c_name x ON x.s1_id = e.s1_id AND x.cand_id = e.cand_id LEFT JOIN c_na y ON y.s1_id = e.s1_id AND y.cand_id = e.cand_id)"""


@query("e18_run_country", "s1_id:s cand_id:s rbits:i kmask:i cos_name:d cos_na:d score:d", f"{W}, {RETRIEVED} SELECT s1_id, cand_id, rbits, kmask, cos_name, cos_na, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY rbits = 512, score DESC, cand_id) AS r FROM cosines) WHERE r <= 100 OR rbits & 512 <> 0")
def e18_run_country(spark, d):
    """Every retriever, cosines, cap of 100 and name-and-number pairs outside the cap."""
    v = Views(spark, d)
    return retrieval.retrieve(v.s1, v.pool, retrieval.Limits(max_df_name=VIEWS["name"][2], max_df_addr=VIEWS["addr"][2]))


SUB = "(length(a_house) = length(a_house_c) AND len(list_filter(range(1, length(a_house) + 1), lambda i: substr(a_house, i, 1) <> substr(a_house_c, i, 1))) = 1)"


@query("h_house_rel", "s1_id:s cand_id:s house_rel:i", f"""{WP} SELECT s1_id, cand_id, CASE WHEN a_house = '' AND a_house_c = '' THEN 8 WHEN a_house = '' OR a_house_c = '' THEN 7 WHEN a_house = a_house_c THEN 0 WHEN ltrim(a_house, '0') = ltrim(a_house_c, '0') THEN 3
 WHEN ends_with(a_house, a_house_c) OR ends_with(a_house_c, a_house) THEN 1 WHEN starts_with(a_house, a_house_c) OR starts_with(a_house_c, a_house) THEN 2 WHEN {SUB} THEN 4
 WHEN length(regexp_replace(a_house, '[^0-9]', '', 'g')) < 9 AND length(regexp_replace(a_house_c, '[^0-9]', '', 'g')) < 9 AND abs(TRY_CAST(regexp_replace(a_house, '[^0-9]', '', 'g') AS BIGINT) - TRY_CAST(regexp_replace(a_house_c, '[^0-9]', '', 'g') AS BIGINT)) <= 10 THEN 5 ELSE 6 END AS house_rel FROM pairs""")
def h_house(spark, d):
    return Views(spark, d).pairs.select("s1_id", "cand_id", features.house_rel().alias("house_rel"))


@query("h_legal_rel", "s1_id:s cand_id:s legal_rel:i", f"""{WP} SELECT s1_id, cand_id, CASE WHEN n_legal = '' AND n_legal_c = '' THEN 0 WHEN n_legal = n_legal_c THEN 1 WHEN n_legal = '' OR n_legal_c = '' THEN 2 WHEN len(list_intersect({tok('n_legal')}, {tok('n_legal_c')})) = 0 THEN 3 ELSE 4 END AS legal_rel FROM pairs""")
def h_legal(spark, d):
    return Views(spark, d).pairs.select("s1_id", "cand_id", features.legal_rel().alias("legal_rel"))


@query("h_built_in", "s1_id:s cand_id:s extra_tok:i missing_tok:i common_tok:i state_rel:i cand_addr_empty:i cand_kind:i cand_native:i cand_src:i len_core_s1:i len_core_c:i", f"""{WP} SELECT s1_id, cand_id,
 len(list_filter(list_distinct({tok('n_core_c')}), lambda t: NOT list_contains({tok('n_core')}, t))) AS extra_tok, len(list_filter(list_distinct({tok('n_core')}), lambda t: NOT list_contains({tok('n_core_c')}, t))) AS missing_tok,
 len(list_intersect({tok('n_core')}, {tok('n_core_c')})) AS common_tok, CASE WHEN a_state = '' OR a_state_c = '' THEN 2 WHEN a_state = a_state_c THEN 1 ELSE 0 END AS state_rel, CAST(a_empty_c AS INT) AS cand_addr_empty,
 CASE n_kind_c WHEN 'domain' THEN 1 WHEN 'handle' THEN 2 WHEN 'empty' THEN 3 ELSE 0 END AS cand_kind, CAST(n_script_c <> 'latin' AS INT) AS cand_native, CAST(source_c = 3 AS INT) AS cand_src, len({tok('n_core')}) AS len_core_s1, len({tok('n_core_c')}) AS len_core_c FROM pairs""")
def h_built_in(spark, d):
    return features.built_in(Views(spark, d).pairs)


@query("h_rank_gap", "s1_id:s cand_id:s name_rank_in_s1:i addr_rank_in_s1:i name_gap_s1:d n_cand_s1:i", f"{WP} SELECT s1_id, cand_id, rank() OVER (PARTITION BY s1_id ORDER BY name_sim DESC) AS name_rank_in_s1, rank() OVER (PARTITION BY s1_id ORDER BY addr_sim DESC) AS addr_rank_in_s1, max(name_sim) OVER (PARTITION BY s1_id) - name_sim AS name_gap_s1, count(*) OVER (PARTITION BY s1_id) AS n_cand_s1 FROM near")
def h_rank_gap(spark, d):
    return features.rank_gap(Views(spark, d).pairs, "name_sim", "addr_sim")


@query("h_similarities", "s1_id:s cand_id:s name_tset:d name_tsort:d name_ratio:d name_partial:d comp_jw:d comp_partial:d alias_tset:d addr_tset:d addr_ratio:d street_tset:d")
def h_similarities(spark, d):
    """D1 to D5 on pairs."""
    return features.similarities(Views(spark, d).pairs)


@query("h_featurize", "s1_id:s cand_id:s name_tset:d addr_tset:d house_rel:i num_jacc:d name_rank_in_s1:i name_gap_s1:d n_cand_s1:i")
def h_featurize(spark, d):
    v = Views(spark, d)
    return features.featurize(v.candidates, v.s1, v.pool)


@query("e19_labels", "s1_id:s cand_id:s label:b", f"{WP} SELECT p.s1_id, p.cand_id, t.match_id IS NOT NULL AS label FROM pairs p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.match_id = p.cand_id")
def e19(spark, d):
    v = Views(spark, d)
    return features.label(v.candidates, v.truth)


HSRAW = "CASE WHEN a_house{0} <> '' AND " + key("a_street{0}") + " <> '' THEN a_house{0} || '|' || " + key("a_street{0}") + " ELSE '' END"
KEYED = f"""k AS (SELECT entity_id, country, source, {key('n_core')} AS n_key, {key('a_full')} AS a_key, {HSRAW.format('')} AS hs_key, a_full, a_street, a_house FROM drec),
kp AS (SELECT *, {key('n_core')} AS n_key, {key('n_core_c')} AS n_key_c, {key('a_full')} AS a_key, {key('a_full_c')} AS a_key_c, {HSRAW.format('')} AS hs_key, {HSRAW.format('_c')} AS hs_key_c FROM near)"""


def _n(source: str, col: str, key_: str) -> str:
    return f"least(coalesce((SELECT count(*) FROM k WHERE k.source {source} AND k.country = kp.country AND k.{col} = kp.{key_} AND k.{col} <> ''), 0), 20)"


def _ctx(v: Views):
    return context.split_context(v.s1, v.pool), context.keyed_pairs(v.pairs)


@query("i1_name_unique", "s1_id:s cand_id:s s1_name_c:i s1_name_self:i pool_name_c:i pool_name_self:i s1_name_c_one:i n_key_equal:i", f"{WP}, {KEYED}, g AS (SELECT s1_id, cand_id, {_n('= 1', 'n_key', 'n_key_c')} AS s1_name_c, {_n('= 1', 'n_key', 'n_key')} AS s1_name_self, {_n('<> 1', 'n_key', 'n_key_c')} AS pool_name_c, {_n('<> 1', 'n_key', 'n_key')} AS pool_name_self, CAST(n_key = n_key_c AND n_key <> '' AS INT) AS n_key_equal FROM kp) SELECT *, CAST(s1_name_c = 1 AS INT) AS s1_name_c_one FROM g")
def i1(spark, d):
    ctx, p = _ctx(Views(spark, d))
    return context.g1_names(p, ctx)


@query("i2_coloc", "s1_id:s cand_id:s s1_addr_c:i s1_addr_self:i pool_addr_c:i s1_hs_c:i a_key_equal:i hs_key_equal:i", f"{WP}, {KEYED} SELECT s1_id, cand_id, {_n('= 1', 'a_key', 'a_key_c')} AS s1_addr_c, {_n('= 1', 'a_key', 'a_key')} AS s1_addr_self, {_n('<> 1', 'a_key', 'a_key_c')} AS pool_addr_c, {_n('= 1', 'hs_key', 'hs_key_c')} AS s1_hs_c, CAST(a_key = a_key_c AND a_key <> '' AS INT) AS a_key_equal, CAST(hs_key = hs_key_c AND hs_key <> '' AS INT) AS hs_key_equal FROM kp")
def i2(spark, d):
    ctx, p = _ctx(Views(spark, d))
    return context.g2_places(p, ctx)


BIZ = ", ".join(f"'{w}'" for w in text.BIZ_WORDS)
EDITS = f"""st AS (SELECT country, tok, count(*) AS df FROM (SELECT country, unnest(list_distinct({tok('n_core')})) AS tok FROM s1) GROUP BY ALL), ns AS (SELECT country, count(*) AS n FROM s1 GROUP BY ALL),
ed AS (SELECT s1_id, cand_id, country, n_core, n_core_c, list_filter(list_distinct({tok('n_core_c')}), lambda t: NOT list_contains({tok('n_core')}, t)) AS ex, list_filter(list_distinct({tok('n_core')}), lambda t: NOT list_contains({tok('n_core_c')}, t)) AS mi FROM pairs)"""


def _stats(side: str) -> str:
    return f"""{side}s AS (SELECT e.s1_id, e.cand_id, sum(CAST(coalesce(t.df, 0) = 0 AS INT)) AS unseen, min(ln(1 + least(coalesce(t.df, 0), 50))) AS lmin, max(ln(1 + least(coalesce(t.df, 0), 50))) AS lmax, max(CASE WHEN t.df >= 50 THEN ln(t.df / CAST(ns.n AS DOUBLE)) END) AS cmax, max(CAST(e.tok IN ({BIZ}) AS INT)) AS biz, max(CAST(regexp_matches(e.tok, '[0-9]') AS INT)) AS digit
 FROM (SELECT s1_id, cand_id, country, unnest({side}) AS tok FROM ed) e LEFT JOIN st t ON t.country = e.country AND t.tok = e.tok LEFT JOIN ns ON ns.country = e.country GROUP BY ALL)"""


@query("i3_token_edits", "s1_id:s cand_id:s ex_n:i mi_n:i ex_unseen_n:i ex_ldf_min:d ex_ldf_max:d ex_lfrac_cmax:d mi_unseen_n:i mi_ldf_max:d ex_biz:i ex_digit:i edit_type:i s1_prefix_of_c:i first_tok_eq:i", f"""{WP}, {EDITS}, {_stats('ex')}, {_stats('mi')}
SELECT ed.s1_id, ed.cand_id, len(ex) AS ex_n, len(mi) AS mi_n, coalesce(x.unseen, 0) AS ex_unseen_n, coalesce(x.lmin, -1) AS ex_ldf_min, coalesce(x.lmax, -1) AS ex_ldf_max, x.cmax AS ex_lfrac_cmax, coalesce(m.unseen, 0) AS mi_unseen_n, coalesce(m.lmax, -1) AS mi_ldf_max, coalesce(x.biz, 0) AS ex_biz, coalesce(x.digit, 0) AS ex_digit,
 CASE WHEN len(ex) = 0 AND len(mi) = 0 THEN 0 WHEN len(mi) = 0 THEN 1 WHEN len(ex) = 0 THEN 2 ELSE 3 END AS edit_type, CAST(n_core <> '' AND starts_with(n_core_c, n_core || ' ') AS INT) AS s1_prefix_of_c, CAST(split_part(n_core, ' ', 1) = split_part(n_core_c, ' ', 1) AS INT) AS first_tok_eq
FROM ed LEFT JOIN exs x ON x.s1_id = ed.s1_id AND x.cand_id = ed.cand_id LEFT JOIN mis m ON m.s1_id = ed.s1_id AND m.cand_id = ed.cand_id""")
def i3(spark, d):
    v = Views(spark, d)
    return context.g3_edits(v.pairs, context.split_context(v.s1, v.pool))


@query("i3a_edits_v1", "s1_id:s cand_id:s ex_idf_max:d ex_idf_sum:d mi_idf_min:d", f"""{WP}, {EDITS}, idf AS (SELECT st.country, tok, ln(n / CAST(df AS DOUBLE)) AS idf FROM st JOIN ns ON ns.country = st.country), top AS (SELECT country, max(idf) AS m FROM idf GROUP BY ALL),
x AS (SELECT e.s1_id, e.cand_id, e.side, max(coalesce(i.idf, t.m, 15.0)) AS hi, min(coalesce(i.idf, t.m, 15.0)) AS lo, sum(coalesce(i.idf, t.m, 15.0)) AS total FROM (SELECT s1_id, cand_id, country, 'ex' AS side, unnest(ex) AS tok FROM ed UNION ALL SELECT s1_id, cand_id, country, 'mi', unnest(mi) FROM ed) e LEFT JOIN idf i ON i.country = e.country AND i.tok = e.tok LEFT JOIN top t ON t.country = e.country GROUP BY ALL)
SELECT ed.s1_id, ed.cand_id, coalesce(a.hi, 0) AS ex_idf_max, coalesce(a.total, 0) AS ex_idf_sum, coalesce(b.lo, 0) AS mi_idf_min FROM ed LEFT JOIN x a ON a.s1_id = ed.s1_id AND a.cand_id = ed.cand_id AND a.side = 'ex' LEFT JOIN x b ON b.s1_id = ed.s1_id AND b.cand_id = ed.cand_id AND b.side = 'mi'""")
def i3a(spark, d):
    v = Views(spark, d)
    return context.g3_edits(v.pairs, context.split_context(v.s1, v.pool), version=1)


@query("i3c_sub_jw", "s1_id:s cand_id:s sub_jw:d", f"""{WP}, {EDITS}, x AS (SELECT s1_id, cand_id, max(jaro_winkler_similarity(a, b)) AS j FROM (SELECT s1_id, cand_id, a, unnest(mi) AS b FROM (SELECT s1_id, cand_id, mi, unnest(ex) AS a FROM ed)) GROUP BY ALL)
SELECT ed.s1_id, ed.cand_id, coalesce(x.j, -1) AS sub_jw FROM ed LEFT JOIN x ON x.s1_id = ed.s1_id AND x.cand_id = ed.cand_id""")
def i3c(spark, d):
    return context.substitution_similarity(Views(spark, d).pairs)


SEC = "list_filter(" + tok("a_numbers{0}") + ", lambda t: t <> a_house{0})"


@query("i4_house", "s1_id:s cand_id:s house_lev:i house_logdiff:d house_reldiff:d house_same_len:i house_first_diff:i house_last_diff:i sec_num_rel:i postcode_rel:i", f"""{WP}, h AS (SELECT *, a_house <> '' AND a_house_c <> '' AS b, abs(TRY_CAST(a_house AS BIGINT) - TRY_CAST(a_house_c AS BIGINT)) AS gap, list_distinct({SEC.format('')}) AS x, list_distinct({SEC.format('_c')}) AS y FROM pairs)
SELECT s1_id, cand_id, CASE WHEN b THEN levenshtein(a_house, a_house_c) ELSE -1 END AS house_lev, CASE WHEN b THEN ln(1 + gap) ELSE -1 END AS house_logdiff, CASE WHEN b THEN gap / CAST(greatest(TRY_CAST(a_house AS BIGINT), TRY_CAST(a_house_c AS BIGINT), 1) AS DOUBLE) ELSE -1 END AS house_reldiff,
 CASE WHEN b THEN CAST(length(a_house) = length(a_house_c) AS INT) ELSE -1 END AS house_same_len, CASE WHEN b THEN CAST(left(a_house, 1) <> left(a_house_c, 1) AS INT) ELSE -1 END AS house_first_diff, CASE WHEN b THEN CAST(right(a_house, 1) <> right(a_house_c, 1) AS INT) ELSE -1 END AS house_last_diff,
 CASE WHEN len(x) = 0 AND len(y) = 0 THEN -1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN len(list_intersect(x, y)) > 0 THEN 1 ELSE 2 END AS sec_num_rel,
 CASE WHEN a_postcode = '' AND a_postcode_c = '' THEN 0 WHEN a_postcode = a_postcode_c THEN 1 WHEN a_postcode = '' OR a_postcode_c = '' THEN 2 ELSE 3 END AS postcode_rel FROM h""")
def i4(spark, d):
    return context.g4_house(Views(spark, d).pairs)


@query("i5_siblings", "s1_id:s cand_id:s sib_n:i sib_house_agree:i sib_s1house_agree:i sib_namekey_same:i sib_house_frac:d sib_s1house_frac:d", f"""{WP}, {KEYED}, b AS (SELECT *, CAST(name_sim >= 80 AND a_house_c <> '' AS INT) AS sib, CAST(name_sim >= 80 AND a_house_c <> '' AND a_house_c = a_house AS INT) AS home FROM kp),
c AS (SELECT s1_id, cand_id, least(sum(sib) OVER (PARTITION BY s1_id) - sib, 20) AS sib_n, CASE WHEN a_house_c <> '' THEN least(sum(sib) OVER (PARTITION BY s1_id, a_house_c) - sib, 20) ELSE -1 END AS sib_house_agree, least(sum(home) OVER (PARTITION BY s1_id) - home, 20) AS sib_s1house_agree, least(count(*) OVER (PARTITION BY s1_id, n_key_c) - 1, 20) AS sib_namekey_same FROM b)
SELECT *, CASE WHEN sib_n > 0 THEN greatest(sib_house_agree, 0) / CAST(sib_n AS DOUBLE) ELSE -1 END AS sib_house_frac, CASE WHEN sib_n > 0 THEN sib_s1house_agree / CAST(sib_n AS DOUBLE) ELSE -1 END AS sib_s1house_frac FROM c""")
def i5(spark, d):
    return context.g5_siblings(context.keyed_pairs(Views(spark, d).pairs), "name_sim")


@query("i6_twins", "s1_id:s cand_id:s twin_n:i twin_house_eq:i twin_addr_margin:d twin_hs_better:i twin_generic:i", f"""{WP}, {KEYED}, few AS (SELECT country, n_key FROM k WHERE source = 1 AND n_key <> '' GROUP BY ALL HAVING count(*) <= 30), gen AS (SELECT country, n_key FROM k WHERE source = 1 AND n_key <> '' GROUP BY ALL HAVING count(*) > 30),
j AS (SELECT kp.s1_id, kp.cand_id, count(*) AS n, max(jaro_winkler_similarity(k.a_full, kp.a_full_c)) AS a, max(CASE WHEN k.a_house = kp.a_house_c AND k.a_house <> '' THEN jaro_winkler_similarity(k.a_street, kp.a_street_c) END) AS hr, max(CAST(k.a_house = kp.a_house_c AND k.a_house <> '' AS INT)) AS heq
 FROM kp JOIN k ON k.source = 1 AND k.country = kp.country AND k.n_key = kp.n_key_c AND k.entity_id <> kp.s1_id JOIN few ON few.country = k.country AND few.n_key = k.n_key WHERE kp.n_key_c <> '' GROUP BY ALL)
SELECT kp.s1_id, kp.cand_id, coalesce(j.n, 0) AS twin_n, coalesce(j.heq, 0) AS twin_house_eq, jaro_winkler_similarity(kp.a_full, kp.a_full_c) - j.a AS twin_addr_margin, CAST(coalesce(j.hr, -1) > jaro_winkler_similarity(kp.a_street, kp.a_street_c) AS INT) AS twin_hs_better, CAST(gen.n_key IS NOT NULL AS INT) AS twin_generic
FROM kp LEFT JOIN j ON j.s1_id = kp.s1_id AND j.cand_id = kp.cand_id LEFT JOIN gen ON gen.country = kp.country AND gen.n_key = kp.n_key_c""")
def i6(spark, d):
    """With Jaro-Winkler in place of the indel similarities, which SQL lacks."""
    from tessera.functions.similarity import udf

    ctx, p = _ctx(Views(spark, d))
    return context.g6_twins(p, ctx, *[udf("jaro_winkler_sql")] * 3)


@query("i7_all_groups", "s1_id:s cand_id:s s1_name_c:i s1_addr_c:i edit_type:i sub_jw:d house_lev:i sib_n:i twin_n:i")
def i7(spark, d):
    """All context groups with the token-set similarity of names."""
    from tessera.functions.similarity import udf

    v = Views(spark, d)
    p = v.pairs.withColumn("name_tset", udf("token_set_ratio")("n_core", "n_core_c"))
    return context.add_features(p, context.split_context(v.s1, v.pool), ("G1", "G2", "G3", "G4", "G5", "G6"), 4)


@query("i9_per_source", "s1_id:s cand_id:s ps_n:i ps_name_sim_rank:i ps_name_sim_gap:d ps_name_sim_n90:i xs_name_sim_max:d ps_addr_sim_rank:i xs_addr_sim_max:d", f"""{WP}, s AS (SELECT *, CAST(source_c = 3 AS INT) AS src FROM near), m AS (SELECT s1_id, src, max(name_sim) AS a, max(addr_sim) AS b FROM s GROUP BY ALL)
SELECT s.s1_id, s.cand_id, count(*) OVER w AS ps_n, rank() OVER (PARTITION BY s.s1_id, s.src ORDER BY name_sim DESC) AS ps_name_sim_rank, max(name_sim) OVER w - name_sim AS ps_name_sim_gap, sum(CAST(name_sim >= 90 AS INT)) OVER w AS ps_name_sim_n90, coalesce(m.a, -1) AS xs_name_sim_max, rank() OVER (PARTITION BY s.s1_id, s.src ORDER BY addr_sim DESC) AS ps_addr_sim_rank, coalesce(m.b, -1) AS xs_addr_sim_max
FROM s LEFT JOIN m ON m.s1_id = s.s1_id AND m.src = 1 - s.src WINDOW w AS (PARTITION BY s.s1_id, s.src)""")
def i9(spark, d):
    return context.g7_per_source(Views(spark, d).pairs.withColumn("cand_src", (F.col("source_c") == 3).cast("int")), ("name_sim", "addr_sim"))


@query("e16_cap_score", "s1_id:s cand_id:s cos_name:d cos_na:d score:d", f"""{WP}, {TERMS}, n AS (SELECT p.s1_id, p.cand_id, coalesce(round(sum(a.w * b.w), 6), 0) AS c FROM pairs p LEFT JOIN vec a ON a.id = p.s1_id AND a.view = 'name' LEFT JOIN vec b ON b.id = p.cand_id AND b.view = a.view AND b.term = a.term GROUP BY ALL), m AS (SELECT p.s1_id, p.cand_id, coalesce(round(sum(a.w * b.w), 6), 0) AS c FROM pairs p LEFT JOIN both_ a ON a.id = p.s1_id LEFT JOIN both_ b ON b.id = p.cand_id AND b.view = a.view AND b.term = a.term GROUP BY ALL)
SELECT p.s1_id, p.cand_id, n.c AS cos_name, m.c AS cos_na, CASE WHEN p.a_empty OR p.a_empty_c THEN n.c ELSE m.c END AS score FROM pairs p JOIN n ON n.s1_id = p.s1_id AND n.cand_id = p.cand_id JOIN m ON m.s1_id = p.s1_id AND m.cand_id = p.cand_id""")
def e16(spark, d):
    v = Views(spark, d)
    a, b, q, p = _vectors(v)
    named = tfidf.row_dot(v.pairs.select("s1_id", "cand_id", "a_empty", "a_empty_c"), a.where("view = 'name'"), b.where("view = 'name'"), "cos_name")
    return tfidf.cap_score(tfidf.row_dot(named, q, p, "cos_na"))
