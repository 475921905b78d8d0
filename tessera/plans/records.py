"""Queries on records: scans, truth, checks, expressions, exact-key retrievers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.hashing import md5_mod, md5_unit
from tessera.functions.similarity import udf
from tessera.operators import blocking, metrics
from tessera.plans.registry import query
from tessera.plans.views import BASE, CORE, HS, KEYS, NAME_NUMBERS, PAIRS, RECORDS, Views, branch, key, skeleton_sql, tok
from tessera.sources import fixtures, sinks, tables

W = f"WITH {RECORDS}"
WP = f"WITH {PAIRS}"


@query("a3_scan_countries", "entity_id:s country:s a_house:s", f"{W} SELECT entity_id, country, a_house FROM drec WHERE country IN ('de', 'fr')")
def a3(spark, d):
    return fixtures.drec(spark, d).where(F.col("country").isin("de", "fr")).select("entity_id", "country", "a_house")


@query("a4_stacked_sources", "source:i country:s n:i", f"{W} SELECT source, country, count(*) AS n FROM drec GROUP BY ALL")
def a4(spark, d):
    s1, pool = fixtures.split(fixtures.drec(spark, d).drop("source").withColumn("source", tables.source_of().cast("int")))
    parts = {1: s1, 2: pool.where("source = 2"), 3: pool.where("source = 3")}
    return tables.stack_sources({k: v.drop("source") for k, v in parts.items()}).groupBy("source", "country").agg(F.count("*").alias("n"))


@query("a5_truth_of_ids", "s1_id:s match_id:s", f"{WP} SELECT t.s1_id, t.match_id FROM truth t WHERE md5_number_upper(t.s1_id) % 5 = 0")
def a5(spark, d):
    v = Views(spark, d)
    raw = v.truth.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.collect_list("match_id"), ",").alias("matched_entity_ids"))
    return tables.truth_pairs(raw, tables.folds(v.spine, v.truth).where("fold = 0").select("s1_id"))


@query("a6_truth_sets", "s1_id:s n:i matches:s", f"{WP} SELECT s.s1_id, count(t.match_id) AS n, coalesce(string_agg(t.match_id, ',' ORDER BY t.match_id), '') AS matches FROM spine s LEFT JOIN truth t ON t.s1_id = s.s1_id GROUP BY s.s1_id")
def a6(spark, d):
    v = Views(spark, d)
    return tables.truth_sets(v.spine.select("s1_id"), v.truth).select("s1_id", F.size("matches").alias("n"), F.array_join("matches", ",").alias("matches"))


@query("a8_integrity", "check_:s n:i", f"""{WP}
SELECT 'repeated_ids' AS "check", count(*) AS n FROM (SELECT entity_id FROM drec GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'wrong_prefix', count(*) FROM drec WHERE CAST(substr(entity_id, 2, 1) AS INT) <> source
UNION ALL SELECT 'unknown_s1', count(*) FROM truth WHERE s1_id NOT IN (SELECT entity_id FROM s1)
UNION ALL SELECT 'unknown_match', count(*) FROM truth WHERE match_id NOT IN (SELECT entity_id FROM pool)
UNION ALL SELECT 'shared_matches', count(*) FROM (SELECT match_id FROM (SELECT DISTINCT s1_id, match_id FROM truth) GROUP BY 1 HAVING count(*) > 1)""".replace('"check"', "check_"))
def a8(spark, d):
    v = Views(spark, d)
    return tables.integrity(v.records, v.truth).withColumnRenamed("check", "check_")


@query("a13_countries", "country:s", f"{W} SELECT DISTINCT country FROM drec")
def a13(spark, d):
    return tables.countries(fixtures.drec(spark, d))


@query("a17_match_lists", "source1_entity_id:s matched_entity_ids:s", f"{WP} SELECT s.s1_id AS source1_entity_id, coalesce(string_agg(a.cand_id, ',' ORDER BY a.cand_id), '') AS matched_entity_ids FROM spine s LEFT JOIN assigned a ON a.s1_id = s.s1_id AND a.prob >= 0.5 GROUP BY s.s1_id")
def a17(spark, d):
    v = Views(spark, d)
    return sinks.match_lists(v.matches, v.s1.select(F.col("entity_id").alias("s1_id"), F.col("doc_id").alias("place")))


@query("a18_candidate_lists", "s1_id:s candidates:s", f"{WP} SELECT s1_id, string_agg(DISTINCT cand_id, ',' ORDER BY cand_id) AS candidates FROM pairs GROUP BY s1_id")
def a18(spark, d):
    v = Views(spark, d)
    return sinks.candidate_lists(v.candidates, v.matches)[0]


@query("a19_diagnostics", "country:s empty_rate:d mean_matches:d", f"{WP} SELECT country, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) AS empty_rate, avg(n) AS mean_matches FROM (SELECT s.s1_id, s.country, count(a.cand_id) AS n FROM spine s LEFT JOIN assigned a ON a.s1_id = s.s1_id AND a.prob >= 0.5 GROUP BY ALL) GROUP BY country")
def a19(spark, d):
    v = Views(spark, d)
    return sinks.diagnostics(sinks.match_lists(v.matches, v.s1.select(F.col("entity_id").alias("s1_id"), F.col("doc_id").alias("place"))), v.spine)


@query("c2_sorted_key", "entity_id:s n_key:s a_key:s", f"{W} SELECT entity_id, {key('n_core')} AS n_key, {key('a_full')} AS a_key FROM drec")
def c2(spark, d):
    return fixtures.drec(spark, d).select("entity_id", text.sorted_key("n_core").alias("n_key"), text.sorted_key("a_full").alias("a_key"))


@query("c5_token_sets", "s1_id:s cand_id:s extra:i missing:i common:i", f"""{WP} SELECT s1_id, cand_id,
 len(list_filter(list_distinct({tok('n_core_c')}), lambda t: NOT list_contains({tok('n_core')}, t))) AS extra,
 len(list_filter(list_distinct({tok('n_core')}), lambda t: NOT list_contains({tok('n_core_c')}, t))) AS missing,
 len(list_filter(list_distinct({tok('n_core')}), lambda t: list_contains({tok('n_core_c')}, t))) AS common FROM pairs""")
def c5(spark, d):
    s, c = text.token_set("n_core"), text.token_set("n_core_c")
    return Views(spark, d).pairs.select("s1_id", "cand_id", F.size(F.array_except(c, s)).alias("extra"), F.size(F.array_except(s, c)).alias("missing"), F.size(F.array_intersect(s, c)).alias("common"))


@query("c16_fold_md5", "s1_id:s fold:i mini:b micro:b fold0x:b n_matches:i", f"""{WP} SELECT s1_id, md5_number_upper(s1_id) % 5 AS fold,
 md5_number_upper(s1_id) % 5 = 0 AND md5_number_upper('sub' || s1_id) % 100 < 20 AS mini, md5_number_upper(s1_id) % 5 = 0 AND md5_number_upper('sub' || s1_id) % 100 < 2 AS micro,
 md5_number_upper(s1_id) % 5 = 0 AND NOT md5_number_upper('sub' || s1_id) % 100 < 20 AS fold0x, n_true AS n_matches FROM ntrue""")
def c16(spark, d):
    v = Views(spark, d)
    return tables.folds(v.spine, v.truth)


UNIT = "((CAST(('0x' || substr(md5({0} || '|orphan'), 1, 16)) AS UBIGINT) % 1000) * 616 + CAST(('0x' || substr(md5({0} || '|orphan'), 17, 16)) AS UBIGINT) % 1000) % 1000 / 1000.0"


@query("c17_unit_md5", "entity_id:s u:d", f"{W} SELECT entity_id, {UNIT.format('entity_id')} AS u FROM s1")
def c17(spark, d):
    return Views(spark, d).s1.select("entity_id", md5_unit(F.col("entity_id"), "|orphan").alias("u"))


@query("d5_jaro_winkler", "s1_id:s cand_id:s jw:d", f"{WP} SELECT s1_id, cand_id, jaro_winkler_similarity(n_compact, n_compact_c) AS jw FROM pairs")
def d5(spark, d):
    return Views(spark, d).pairs.select("s1_id", "cand_id", udf("jaro_winkler")("n_compact", "n_compact_c").alias("jw"))


@query("d6_levenshtein", "s1_id:s cand_id:s name_lev:i house_lev:i", f"{WP} SELECT s1_id, cand_id, levenshtein(n_core, n_core_c) AS name_lev, levenshtein(a_house, a_house_c) AS house_lev FROM pairs")
def d6(spark, d):
    return Views(spark, d).pairs.select("s1_id", "cand_id", F.levenshtein("n_core", "n_core_c").alias("name_lev"), F.levenshtein("a_house", "a_house_c").alias("house_lev"))


@query("d8_dense_cosine", "vec_id:i other:i cos:d", """SELECT a.vec_id, b.vec_id AS other, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def d8(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", "other", text.cosine("embedding", "b").alias("cos"))


@query("d9_number_jaccard", "s1_id:s cand_id:s num_jacc:d", f"""{WP}, n AS (SELECT s1_id, cand_id, list_distinct({tok('a_numbers')}) AS x, list_distinct({tok('a_numbers_c')}) AS y FROM pairs)
SELECT s1_id, cand_id, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN -1.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END AS num_jacc FROM n""")
def d9(spark, d):
    return Views(spark, d).pairs.select("s1_id", "cand_id", text.jaccard(text.tokens("a_numbers"), text.tokens("a_numbers_c")).alias("num_jacc"))




@query("e1_token_df", "country:s t:s df:i", f"{W}, {CORE} SELECT country, t, df FROM tdf")
def e1(spark, d):
    return blocking.token_df(Views(spark, d).pool)




@query("e2_make_keys", "entity_id:s kt:s key:s", f"{W}, {KEYS} SELECT entity_id, kt, key FROM keys")
def e2(spark, d):
    v = Views(spark, d)
    return blocking.make_keys(v.records, blocking.token_df(v.pool))


@query("e3_cap_keys", "entity_id:s kt:s key:s", f"{W}, {KEYS} SELECT entity_id, kt, key FROM capped")
def e3(spark, d):
    v = Views(spark, d)
    return blocking.cap_keys(blocking.make_keys(v.pool, blocking.token_df(v.pool)))


@query("e4_keys_v0", "s1_id:s cand_id:s kmask:i", f"{W}, {KEYS} SELECT q.entity_id AS s1_id, p.entity_id AS cand_id, bit_or(c.bit) AS kmask FROM keys q JOIN capped p ON p.country = q.country AND p.kt = q.kt AND p.key = q.key JOIN caps c ON c.kt = q.kt WHERE q.source = 1 GROUP BY ALL")
def e4(spark, d):
    v = Views(spark, d)
    return blocking.keys_v0(v.s1, v.pool)


def joined(expr: str, cap: int, least: int = 1, pool: str = "pool") -> str:
    """SQL of a capped single-key join."""
    return f"""k AS (SELECT entity_id, country, source, {expr} AS key FROM s1 UNION ALL SELECT entity_id, country, source, {expr} FROM {pool}),
g AS (SELECT country, key FROM k WHERE source <> 1 AND length(key) >= {least} GROUP BY ALL HAVING count(*) <= {cap})
SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM k a JOIN k b ON b.country = a.country AND b.key = a.key JOIN g ON g.country = b.country AND g.key = b.key WHERE a.source = 1 AND b.source <> 1"""


@query("e5a_akey", "s1_id:s cand_id:s", f"{W}, {joined(key('a_full'), 100)}")
def e5a(spark, d):
    v = Views(spark, d)
    return blocking.akey(v.s1, v.pool)




@query("e5b_hskey", "s1_id:s cand_id:s", f"{W}, {joined(HS, 100)}")
def e5b(spark, d):
    v = Views(spark, d)
    return blocking.hskey(v.s1, v.pool)




@query("e5c_skel", "s1_id:s cand_id:s", f"{W}, {joined(skeleton_sql(), 100, 4)}")
def e5c(spark, d):
    v = Views(spark, d)
    return blocking.skel(v.s1, v.pool)


@query("e5d_nkey_empty", "s1_id:s cand_id:s", f"{W}, nowhere AS (SELECT * FROM pool WHERE a_empty), {joined(key('n_core'), 300, 3, 'nowhere')}")
def e5d(spark, d):
    v = Views(spark, d)
    return blocking.nkey_empty(v.s1, v.pool)


@query("e5e_nkey_num", "s1_id:s cand_id:s", f"""{W}, k AS ({NAME_NUMBERS}), g AS (SELECT country, key FROM k WHERE source <> 1 GROUP BY ALL HAVING count(*) <= 50)
SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM k a JOIN k b ON b.country = a.country AND b.key = a.key JOIN g ON g.country = b.country AND g.key = b.key WHERE a.source = 1 AND b.source <> 1""")
def e5e(spark, d):
    v = Views(spark, d)
    return blocking.nkey_num(v.s1, v.pool)


@query("e5f_prefix_key", "s1_id:s cand_id:s", f"{W}, {joined(chr(39).join(['country || ', '|', ' || substr(n_compact, 1, 8)']), 300, 5)}")
def e5f(spark, d):
    v = Views(spark, d)
    return blocking.prefix_key(v.s1, v.pool)


RBITS = f"""{branch("ra", key("a_full"), 100, 1, 8)}, {branch("rh", HS, 100, 1, 16)}, {branch("rs", skeleton_sql(), 100, 4, 64)},
cands AS (SELECT s1_id, cand_id, bit_or(bit) AS rbits FROM (SELECT * FROM ra UNION ALL SELECT * FROM rh UNION ALL SELECT * FROM rs) GROUP BY ALL)"""


def unioned(v: Views):
    return blocking.union({"akey": blocking.akey(v.s1, v.pool), "hskey": blocking.hskey(v.s1, v.pool), "skel": blocking.skel(v.s1, v.pool)})


@query("e15_union", "s1_id:s cand_id:s rbits:i", f"{W}, {RBITS} SELECT s1_id, cand_id, rbits FROM cands")
def e15(spark, d):
    return unioned(Views(spark, d))


@query("e17_cap", "s1_id:s cand_id:s", f"{WP} SELECT s1_id, cand_id FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM preds) WHERE r <= 20")
def e17(spark, d):
    return blocking.cap_per_query(Views(spark, d).preds, "prob", 20)


@query("e20_augment", "s1_id:s cand_id:s rbits:i", f"{W}, {RBITS}, {branch('rc', 'substr(n_compact, 1, 8)', 300, 5, 512)} SELECT coalesce(c.s1_id, n.s1_id) AS s1_id, coalesce(c.cand_id, n.cand_id) AS cand_id, coalesce(c.rbits, 0) | coalesce(n.bit, 0) AS rbits FROM cands c FULL JOIN rc n ON n.s1_id = c.s1_id AND n.cand_id = c.cand_id")
def e20(spark, d):
    v = Views(spark, d)
    return blocking.augment(unioned(v), blocking.key_join(v.s1, v.pool, F.substring("n_compact", 1, 8), 300, 5), blocking.RBITS["nkey_num"])


@query("m6_marginal_recall", "retriever:s pairs:i alone:d marginal:d", f"""{WP}, {RBITS}, m AS (SELECT coalesce(c.rbits, 0) AS b FROM truth t LEFT JOIN cands c ON c.s1_id = t.s1_id AND c.cand_id = t.match_id)
{" UNION ALL ".join(f"SELECT '{n}' AS retriever, (SELECT count(*) FROM cands WHERE rbits & {b} <> 0) AS pairs, avg(CASE WHEN b & {b} <> 0 THEN 1.0 ELSE 0 END) AS alone, avg(CASE WHEN b <> 0 AND b & ~{b} = 0 THEN 1.0 ELSE 0 END) AS marginal FROM m" for n, b in (("akey", 8), ("hskey", 16), ("skel", 64)))}""")
def m6(spark, d):
    v = Views(spark, d)
    return metrics.marginal_recall(unioned(v), v.truth, {n: blocking.RBITS[n] for n in ("akey", "hskey", "skel")})


PREC = "prec AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS source, p_type AS country, p_name AS n_core, CAST(p_size AS VARCHAR) AS a_house, p_partkey FROM part), pr AS (SELECT 'S' || source || '-' || p_partkey AS entity_id, * FROM prec)"


@query("e5g_dense_blocks", "s1_id:s cand_id:s", f"""WITH {PREC}, k AS (SELECT entity_id, country, source, {key('n_core')} AS key FROM pr), g AS (SELECT country, key FROM k WHERE source <> 1 GROUP BY country, key HAVING count(*) <= 5)
SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM k a JOIN k b ON b.country = a.country AND b.key = a.key JOIN g ON g.country = b.country AND g.key = b.key WHERE a.source = 1 AND b.source <> 1""")
def e5g(spark, d):
    """Name keys over a small vocabulary, where caps fire."""
    s1, pool = fixtures.split(fixtures.prec(spark, d))
    return blocking.key_join(s1, pool, text.sorted_key("n_core"), 5)


@query("a9_samples", "kind:s id:s", f"""{WP}, c AS (SELECT DISTINCT s1_id AS id FROM truth), f AS (SELECT entity_id AS id FROM pool WHERE entity_id NOT IN (SELECT match_id FROM truth))
SELECT 'cluster' AS kind, id FROM (SELECT id FROM c ORDER BY md5(id || '7'), id LIMIT 20) UNION ALL SELECT 'distractor', id FROM (SELECT id FROM f ORDER BY md5(id || '7'), id LIMIT 30)""")
def a9(spark, d):
    v = Views(spark, d)
    return tables.audit_samples(v.records, v.truth, 20, 30)


@query("a14_cache_union", "s1_id:s cand_id:s rbits:i kmask:i is_es:b", f"""{W}, {RBITS}, {branch('rc', 'substr(n_compact, 1, 8)', 300, 5, 3)}
SELECT s1_id, cand_id, rbits, rbits & 15 AS kmask, false AS is_es FROM cands UNION ALL SELECT s1_id, cand_id, bit, 7, CAST(substr(s1_id, 4) AS INT) % 2 = 0 FROM rc""")
def a14(spark, d):
    v = Views(spark, d)
    late = blocking.key_join(v.s1, v.pool, F.substring("n_compact", 1, 8), 300, 5).withColumns({"rbits": F.lit(3), "kmask": F.lit(7), "role": F.when(F.substring("s1_id", 4, 20).cast("int") % 2 == 0, "es").otherwise("train")})
    return tables.load_cache([unioned(v), late])


@query("a23_text_export", "row:i text:s", f"{W} SELECT row_number() OVER (ORDER BY entity_id) - 1 + 100 AS row, n_core || ' | ' || a_full AS text FROM s1")
def a23(spark, d):
    return tables.text_export(Views(spark, d).s1, 100)


@query("e18_candidates", "s1_id:s cand_id:s rbits:i kmask:i", f"{W}, {BASE} SELECT b.s1_id, b.cand_id, b.rbits, coalesce(m.kmask, 0) AS kmask FROM base b LEFT JOIN b_keys m ON m.s1_id = b.s1_id AND m.cand_id = b.cand_id")
def e18(spark, d):
    """All exact-key retrievers at their own caps, in one plan."""
    v = Views(spark, d)
    return blocking.candidates(v.s1, v.pool)


@query("b4_normalize", "entity_id:s n_full:s n_core:s n_legal:s n_alias:s n_kind:s a_full:s a_house:s a_postcode:s a_state:s a_nparts:i n_script:s")
def b4(spark, d):
    """Names and addresses normalized from raw lines."""
    from tessera.functions.normalize import normalize

    docs = spark.read.parquet(f"{d}/documents.parquet")
    raw = docs.select(F.concat(F.lit("S1-"), F.col("doc_id")).alias("entity_id"), F.substring("text", 1, 60).alias("business_name"), F.concat_ws(", ", (F.col("n_chars") % 1000).cast("string"), F.substring("text", 61, 60)).alias("business_address"), F.col("lang").alias("country"))
    return normalize(raw)
