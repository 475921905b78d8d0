"""Golden cases and brute-force checks of the record-linkage operators on tiny tables."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.functions.text import house_street_key, jaccard, name_number_keys, skeleton, sorted_key, tokens
from tessera.operators import blocking, context, decision, evaluation, features, metrics, models, retrieval, robust, tfidf
from tessera.sources import sinks, tables


def values(df, *cols):
    return [tuple(r) for r in df.select(*(cols or ["*"])).collect()]


def test_keys(spark):
    df = spark.createDataFrame([("blu impeks praivet", "08", "greenwood rd"), ("blue impex private", "8", "rd greenwood"), ("pharst lksmi", "", "x road"), ("first laxmi", None, None)], "n_core string, a_house string, a_street string")
    rows = values(df, skeleton("n_core"), house_street_key())
    assert rows[0] == ("bl|mpks", "8|greenwood") == rows[1]
    assert rows[2][0] == rows[3][0] and rows[2][1] == rows[3][1] == ""
    assert values(df, sorted_key("n_core"))[0] == ("blu impeks praivet",) and df.select(jaccard(tokens("a_house"), tokens("a_house")).alias("j")).collect()[3].j == -1.0
    nk = spark.createDataFrame([("b a a", "12 0-7/012"), ("", "1")], "n_core string, a_numbers string").select(name_number_keys().alias("k")).collect()
    assert sorted(nk[0].k) == ["a b|12", "a b|7"] and nk[1].k == []


def records(spark, rows):
    return spark.createDataFrame([(i, "x", k) for i, k in rows], "entity_id string, country string, n_core string")


def test_key_join_and_union(spark):
    q, p = records(spark, [("S1-0", "a"), ("S1-1", "b"), ("S1-2", "")]), records(spark, [("S2-0", "a"), ("S2-1", "a"), ("S2-2", "b"), ("S2-3", "b"), ("S2-4", "b"), ("S2-5", "")])
    assert sorted(values(blocking.key_join(q, p, F.col("n_core"), 2), "s1_id", "cand_id")) == [("S1-0", "S2-0"), ("S1-0", "S2-1")]
    a, b = (spark.createDataFrame(x, "s1_id string, cand_id string") for x in ([("0", "5"), ("1", "6")], [("0", "5")]))
    assert sorted(values(blocking.union({"tf_name": a, "akey": b}), "s1_id", "cand_id", "rbits")) == [("0", "5", 10), ("1", "6", 2)]


def test_cap_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("s", c, 1.0) for c in "dcba"], "s1_id string, cand_id string, score double")
    assert sorted(r.cand_id for r in blocking.cap_per_query(df, "score", 2).collect()) == ["a", "b"]


def test_name_and_number_pairs_stand_outside_the_cap(spark):
    rows = [("s", "a", 1, 0.9), ("s", "b", 512, 0.8), ("s", "c", 1, 0.7), ("s", "d", 1, 0.7), ("s", "e", 513, 0.1), ("t", "a", 512, 0.0)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, rbits int, score double")
    assert sorted(values(retrieval.cap_outside(df, 512, 2), "s1_id", "cand_id")) == [("s", "a"), ("s", "b"), ("s", "c"), ("s", "e"), ("t", "a")]


def test_tfidf_equals_dense(spark):
    texts = {"S1-1": "acme blue works", "S1-2": "red fox inn", "S2-1": "acme blue wrks", "S3-1": "red fox", "S2-2": "zebra"}
    df = spark.createDataFrame([(i, "x", t) for i, t in texts.items()], "entity_id string, country string, n_core string")
    a, b = tfidf.vectors(df.where("entity_id LIKE 'S1%'"), df.where("entity_id NOT LIKE 'S1%'"), {"name": ("n_core", 3, 1.0)})
    top = {(r.s1_id, r.cand_id): r.s for r in tfidf.top_k(a, b, 5).collect()}
    grams = lambda t: [g for w in t.split() for g in ((f" {w} ")[k : k + 3] for k in range(len(w)))]
    df_ = {}
    for t in texts.values():
        for g in set(grams(t)):
            df_[g] = df_.get(g, 0) + 1

    def vec(t):
        v = {g: (1 + math.log(grams(t).count(g))) * (math.log(6 / (1 + df_[g])) + 1) for g in set(grams(t))}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()}

    for i, j in itertools.product([k for k in texts if k[1] == "1"], [k for k in texts if k[1] != "1"]):
        x, y = vec(texts[i]), vec(texts[j])
        s = sum(w * y.get(g, 0) for g, w in x.items())
        assert abs(top.get((i, j), 0.0) - s) < 1e-5


def crowded(spark, seed=3):
    """Vectors of two countries whose records share a few frequent terms, with many equal scores; both sides as rows too."""
    rng, sides = np.random.default_rng(seed), []
    for side, n in (("S1", 40), ("S2", 90)):
        sides.append([(f"{side}-{i}", "ab"[i % 2], v, f"t{t}", float(rng.integers(1, 4)) / 8) for i in range(n) for v in ("name", "addr") for t in rng.choice(6, rng.integers(0, 4), replace=False)])
    return *sides, *(spark.createDataFrame(x, "id string, country string, view string, term string, w double") for x in sides)


def brute_dots(q, p):
    dots = {}
    for (a, c, v, t, w), (b, *key, x) in itertools.product(q, p):
        if [c, v, t] == key:
            dots[a, b] = dots.get((a, b), 0.0) + w * x
    return dots


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tfidf, "BLOCK", 13)
    monkeypatch.setattr(tfidf, "SMALL", 4)


def joins_by_term(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and x.count("term#") > 1]


@pytest.mark.parametrize("k,threshold", [(1, 0.0), (4, 0.0), (4, 0.2), (500, 0.0)])
def test_top_k_over_blocks_equals_brute_force(spark, small_blocks, k, threshold):
    q, p, queries, pool = crowded(spark)
    found, want = tfidf.top_k(queries, pool, k, threshold), set()
    dots = brute_dots(q, p)
    for a in {x for x, _ in dots}:
        best = sorted((-round(s, 6), b) for (x, b), s in dots.items() if x == a and round(s, 6) > threshold)
        want |= {(a, b, -s) for s, b in best[:k]}
    assert set(values(found, "s1_id", "cand_id", "s")) == want
    assert joins_by_term(found) == []  # pairs that share a term are never rows


def test_given_pairs_meet_vectors_in_a_grid(spark):
    q, p, queries, pool = crowded(spark, 5)
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", i + j) for i in range(42) for j in range(0, 95, 3)], "s1_id string, cand_id string, mark int")
    found = tfidf.view_dots(pairs, queries, pool, ["name", "addr"])
    dots = {v: brute_dots(*[[(a, "", *rest) for a, _, *rest in x if rest[0] == v] for x in (q, p)]) for v in ("name", "addr")}
    want = {(a, b, m, *(round(dots[v].get((a, b), 0.0), 9) for v in ("name", "addr"))) for a, b, m in values(pairs)}
    assert {(a, b, m, round(x, 9), round(y, 9)) for a, b, m, x, y in values(found, "s1_id", "cand_id", "mark", "name", "addr")} == want
    assert all(y == round(x, 6) for x, y in ((dots["name"].get((a, b), 0.0) + dots["addr"].get((a, b), 0.0), c) for a, b, c in values(tfidf.row_dot(pairs, queries, pool), "s1_id", "cand_id", "cos")))
    assert joins_by_term(found) == []  # pairs do not become a row for each term


def test_no_retriever_and_no_cosine_joins_by_term(spark, small_blocks):
    rows = [(f"S{1 + i % 3}-{i}", "en", f"name{i % 5} x{i % 7}", f"street{i % 4} city{i % 9}", "1", f"street{i % 4}", "1", f"name{i % 5}x{i % 7}", "", i % 6 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, country string, n_core string, a_full string, a_house string, a_street string, a_numbers string, n_compact string, n_alias string, a_empty boolean")
    s1, pool = df.where("entity_id LIKE 'S1%'"), df.where("entity_id NOT LIKE 'S1%'")
    assert joins_by_term(retrieval.retrieve(s1, pool, retrieval.Limits(k_name=3, k_rev=2, max_df_name=0.5, max_df_addr=0.5))) == []


@pytest.mark.parametrize("k", [1, 3])
def test_reverse_top_k_over_blocks_equals_brute_force(spark, small_blocks, k):
    q, p, queries, pool = crowded(spark, 7)
    found, want = tfidf.reverse_top_k(queries, pool, k), set()
    dots = brute_dots(q, p)
    for b in {x for _, x in dots}:
        best = sorted((-round(s, 6), a) for (a, x), s in dots.items() if x == b)
        want |= {(a, b, -s) for s, a in best[:k]}
    assert set(values(found, "s1_id", "cand_id", "s")) == want
    assert joins_by_term(found) == []


def shuffled(spark, run):
    """Rows that run() writes to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=(-1, 0))
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_reverse_top_k_shuffles_records_not_the_pairs_that_share_a_term(spark):
    """The disk of a search grows with its records: 180,000 pairs share the term."""
    side = lambda name, n: spark.createDataFrame([(f"{name}-{i:03d}", "en", "name", "t", 1.0 + i % 2) for i in range(n)], "id string, country string, view string, term string, w double")
    s1, pool, found = side("S1", 300), side("S2", 600), []
    rows = shuffled(spark, lambda: found.extend(values(tfidf.reverse_top_k(s1, pool, 3), "s1_id", "cand_id", "s")))
    assert sorted(found) == sorted((f"S1-{a:03d}", f"S2-{b:03d}", 2.0 * (1 + b % 2)) for a in (1, 3, 5) for b in range(600))
    assert 900 <= rows < 20 * 900


def test_similarities():
    assert similarity.ratio("abcd", "abxd") == 75.0 and similarity.ratio("", "") == 100.0
    assert similarity.token_set_ratio("acme works", "acme works north") == 100.0 and similarity.token_set_ratio("acme", "zebra inn") < 50
    assert similarity.partial_ratio("abc", "xxabcxx") == 100.0 and similarity.token_sort_ratio("b a", "a b") == 100.0
    assert similarity.jaro_winkler("co", "cp") > 0.6 and similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert similarity.lcs(a, b) == t[-1, -1]


def test_jaro_winkler_equals_sql():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abc e"), n))
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "a"), *[(word(a), word(b)) for a, b in rng.integers(0, 90, (3000, 2))], *[("abc" + word(a), "abc" + word(b)) for a, b in rng.integers(0, 30, (3000, 2))]]
    con = duckdb.connect()
    con.register("p", pd.DataFrame(pairs, columns=["a", "b"]))
    want = con.execute("SELECT a, b, jaro_winkler_similarity(a, b) FROM p").fetchall()
    assert [x for x in want if similarity.jaro_winkler_sql(*x[:2]) != x[2]] == []
    assert similarity.jaro_winkler("", "") == 1.0


def test_house_codes(spark):
    cases = [("", "", 8), ("1", "", 7), ("12", "12", 0), ("08", "8", 3), ("112", "12", 1), ("12", "125", 2), ("128", "148", 4), ("98", "104", 5), ("10", "999", 6), ("1a", "2b", 5), ("12a", "15", 5), ("a", "b", 4), ("ab", "cd", 6), ("1a", "", 7), ("123456789", "123456780x", 6)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a_house string, a_house_c string").select(features.house_rel().alias("r"))
    assert [r.r for r in df.collect()] == [c for *_, c in cases]


PREDS = [("a", "S2-1", 0.9), ("a", "S3-2", 0.8), ("a", "S2-3", 0.3), ("b", "S2-4", 0.6), ("c", "S3-5", 0.95)]
TRUTH = [("a", "S2-1"), ("a", "S3-2"), ("c", "S3-5"), ("c", "S2-9")]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(PREDS, "s1_id string, cand_id string, prob double")


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTH, "s1_id string, match_id string")


@pytest.fixture(scope="module")
def spine(spark):
    return spark.createDataFrame([(x, "US") for x in "abcd"], "s1_id string, country string")


def test_assign(spark):
    p = spark.createDataFrame([("a", "S2-1", 0.7), ("b", "S2-1", 0.9), ("a", "S3-2", 0.8)], "s1_id string, cand_id string, prob double")
    best = {(r.s1_id, r.cand_id): r.margin for r in decision.assign_best(p).collect()}
    assert best.keys() == {("b", "S2-1"), ("a", "S3-2")} and best["b", "S2-1"] == pytest.approx(0.2)
    assert values(decision.threshold(decision.assign_best(p), 0.85)) == [("b", "S2-1")]


def f(pred, true):
    tp = len(pred & true)
    return 1.0 if not pred and not true else 0.0 if not tp else 1.25 * tp / (0.25 * len(true) + len(pred))


@pytest.mark.parametrize("p", [[0.9, 0.6, 0.2], [0.3, 0.2], [0.95, 0.9, 0.8, 0.1, 0.05], [0.5]])
def test_expected_f05_equals_enumeration(p):
    got = decision.expected_f05(np.array(p))
    for k in range(len(p) + 1):
        want = sum(np.prod([x if hit else 1 - x for x, hit in zip(p, lab, strict=True)]) * f(set(range(k)), {i for i, hit in enumerate(lab) if hit}) for lab in itertools.product([0, 1], repeat=len(p)))
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_set_decision(spark, preds, truth, spine):
    k = decision.oracle_k(preds, truth, spine)
    assert sorted(values(k, "s1_id", "k")) == [("a", 2), ("b", 0), ("c", 1), ("d", 0)]
    assert sorted(values(decision.top_k_matches(preds, k))) == [("a", "S2-1"), ("a", "S3-2"), ("c", "S3-5")]
    prof = {r.s1_id: r for r in decision.profile(preds, spine).collect()}
    assert prof["a"].p1 == 0.9 and prof["a"].gap1 == pytest.approx(0.1) and prof["a"].s3_ge50 == 1 and prof["d"].n_assigned == 0
    rel = {r.cand_id: r for r in decision.relative_features(preds).collect()}
    assert rel["S3-2"].r_rank == 1 and rel["S2-3"].r_ratio == pytest.approx(0.3 / 0.9) and rel["S2-3"].r_mass_above == pytest.approx(1.7)
    d = spark.createDataFrame([([1.0 if j == c else 0.0 for j in range(6)],) for c in range(6)] + [([0.4, 0.0, 0.0, 0.6, 0.0, 0.0],)], "probability array<double>")
    assert [r.k for r in decision.choose_k(d, classes=6, most=6).collect()] == [0, 1, 2, 3, 4, 5, 3]


def test_metrics(spark, truth, spine):
    spec = metrics.entity_scores(spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "s1_id string, match_id string"), spark.createDataFrame([("a", "x"), ("a", "z")], "s1_id string, match_id string"), spine.where("s1_id = 'a'"))
    assert spec.first().f05 == pytest.approx(0.7143, abs=1e-4)
    none = spark.createDataFrame([], "s1_id string, match_id string")
    scores = metrics.entity_scores(none, spark.createDataFrame([("b", "S2-1")], "s1_id string, match_id string"), spine.where("s1_id < 'c'"))
    assert metrics.macro_f05(scores) == 0.5
    with pytest.raises(ValueError):
        metrics.macro_f05(scores.limit(0))
    a, b = (spark.createDataFrame([(c, v) for c in "abcdefghij"], "s1_id string, f05 double") for v in (0.5, 0.6))
    boot = metrics.paired_bootstrap(a, b, 100).first()
    assert boot.delta == pytest.approx(0.1) and boot.p_not_better == 0.0


def test_rules(spark):
    s1 = spark.createDataFrame([("S1-1", "US", "acme", "1 a st"), ("S1-2", "US", "beta", "5 b st"), ("S1-3", "US", "beta", "9 b st"), ("S1-4", "US", "gamma", "7 c st")], "entity_id string, country string, n_core string, a_full string")
    rows = [("S1-1", "S2-1", "acme", "acme", "1 a st", "", True, 0.2), ("S1-2", "S2-2", "beta", "beta", "5 b st", "", True, 0.9), ("S1-4", "S2-3", "gamma", "zulu inn", "7 c st", "7 c st", False, 0.1), ("S1-4", "S2-4", "gamma", "gamma x", "7 c st", "7 c st", False, 0.1)]
    pairs = spark.createDataFrame([(s, c, "US", n, nc, a, ac, e, p) for s, c, n, nc, a, ac, e, p in rows], "s1_id string, cand_id string, country_c string, n_core string, n_core_c string, a_full string, a_full_c string, a_empty_c boolean, prob double")
    pairs = pairs.withColumns({"n_key": sorted_key("n_core"), "n_key_c": sorted_key("n_core_c"), "a_key": sorted_key("a_full"), "a_key_c": sorted_key("a_full_c")})
    got = {r.cand_id: r for r in decision.rule_flags(pairs, s1).withColumn("keep", decision.keep(0.5)).collect()}
    order = ["S2-1", "S2-2", "S2-3", "S2-4"]
    assert [got[c].rule_a for c in order] == [True, False, False, False] and [got[c].drop_a for c in order] == [False, True, False, False]
    assert [got[c].rule_b for c in order] == [False, False, True, False] and [got[c].keep for c in order] == [True, False, True, False]


def test_density_matching(spark):
    rows = spark.createDataFrame([("a", "v", 0.99, True), ("a", "w", 0.8, False), ("b", "x", 0.85, False), ("c", "y", 0.9, True), ("c", "z", 0.3, True)], "s1_id string, cand_id string, prob double, label boolean")
    c = robust.copies(rows, 3.0, 0.2, 0.975)
    assert [r.copies for r in c.orderBy("cand_id").collect()] == [1, 3, 3, 1, 1]
    assert robust.negative_weight(2, 0.2, 0.1) == pytest.approx(3) and robust.negative_weight(0.5, 0.2, 0.1) == 1
    spine = spark.createDataFrame([("a", 1), ("b", 0), ("c", 3), ("d", 0)], "s1_id string, n_true int")
    clean = {r.s1_id: r.f05 for r in robust.dm_entity_f05(rows.withColumn("copies", F.lit(1)), spine, 0.75).collect()}
    assert clean == pytest.approx({"a": f({"v", "w"}, {"v"}), "b": 0.0, "c": f({"y"}, {"y", "z", "q"}), "d": 1.0})
    more = {r.s1_id: r.f05 for r in robust.dm_entity_f05(c, spine, 0.75).collect()}
    assert more["a"] < clean["a"] and more["b"] == 0 and more["d"] == 1


def test_removal(spark):
    rows = [("acme", "1 a st", "1"), ("acme", "2 a st", "02"), ("beta", "5 b st", "5"), ("beta", "5 b st", "05"), ("gamma", "7 c st", "7"), ("delta", "9 d st", "9")]
    s1 = spark.createDataFrame([(f"S1-{k}", "US", n, a, "a st", h) for k, (n, a, h) in enumerate(rows)], "entity_id string, country string, n_core string, a_full string, a_street string, a_house string")
    assert [r.twin for r in robust.twin_flag(s1).orderBy("entity_id").collect()] == [True, True, False, False, False, False]
    assert [r.removed for r in robust.removal_mask(s1, 1.0, "twin").orderBy("entity_id").collect()] == [True, True, False, False, False, False]
    big = spark.range(4000).select(F.concat(F.lit("S1-"), F.col("id")).alias("entity_id"), F.lit("US").alias("country"), F.concat(F.lit("n"), F.col("id") % 3000).alias("n_core"), F.col("id").cast("string").alias("a_full"), F.lit("").alias("a_street"), F.lit("").alias("a_house"))
    for variant in ("uniform", "biased"):
        assert robust.removal_mask(big, 0.19, variant).agg(F.avg(F.col("removed").cast("int"))).first()[0] == pytest.approx(0.19, abs=0.03)
    with pytest.raises(ValueError):
        robust.removal_mask(s1, 0.1, "other")


def test_loss_parts(spark, truth, spine):
    pred = spark.createDataFrame([("a", "S2-1"), ("a", "zz"), ("b", "S2-4")], "s1_id string, match_id string")
    row = robust.loss_decomposition(metrics.entity_scores(pred, truth, spine)).first()
    assert row.fp_singleton == 0.25 and row.loss == pytest.approx(row.fp_singleton + row.fp_other + row.fn)


def test_context(spark):
    X = spark.createDataFrame([("a", p, s, n, a, c) for p, s, n, a, c in zip("pqrs", (0, 0, 1, 1), (100.0, 80.0, 95.0, 60.0), (90.0, 90.0, 50.0, None), (0.9, 0.5, None, 0.2), strict=True)] + [("b", "t", 0, 70.0, 10.0, 0.1)], "s1_id string, cand_id string, cand_src int, name_tset double, addr_tset double, cos_na double")
    rows = context.g7_per_source(X).orderBy("cand_id").collect()
    assert [r.ps_name_tset_rank for r in rows] == [1, 2, 1, 2, 1] and [r.ps_name_tset_gap for r in rows] == [0, 20, 0, 35, 0]
    assert [r.xs_name_tset_max for r in rows] == [95, 95, 100, 100, -1] and [r.ps_name_tset_n90 for r in rows] == [1, 1, 1, 1, 0]
    q = spark.createDataFrame([(-3.26,), (-3.24,), (None,)], "x double").select(context.q05("x").alias("q")).collect()
    assert [r.q for r in q] == [-3.5, -3.0, None]


def test_token_map(spark):
    pairs = spark.createDataFrame([("gret phaumdesn", "great foundation")] * 3 + [("acme", "acme"), ("one two", "one")], "name string, s1_name string")
    learned = models.token_map(pairs)
    assert {r.src: r.dst for r in learned.collect()} == {"gret": "great", "phaumdesn": "foundation"}
    records_ = spark.createDataFrame([("x", "gret inn")], "entity_id string, n_core string")
    assert models.apply_token_map(records_, learned).first().n_core == "great inn"


def test_cross_fit_and_roles(spark):
    s = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.1, 0.9), (-1, 0.1, 0.9)], "cf int, l0 double, l1 double")
    assert [r.score for r in models.cross_fit_merge(s).collect()] == pytest.approx([0.9, 0.1, 0.5])


def test_sinks(spark, spine, tmp_path):
    placed = spine.withColumn("place", F.ascii("s1_id"))
    m = spark.createDataFrame([("a", "S2-5"), ("a", "S3-7 "), ("a", "S2-5"), ("b", "X-1")], "s1_id string, match_id string")
    lists = sinks.match_lists(m, placed)
    stats = sinks.write_match_tsv(lists, f"{tmp_path}/out")
    text = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_bytes().decode()
    assert text == "source1_entity_id\tmatched_entity_ids\na\tS2-5,S3-7\nb\t\nc\t\nd\t\n" and stats == {"rows": 4, "with_match": 1, "pairs": 2}
    assert all(r.n == 0 for r in sinks.validate(lists, placed).collect())
    back = sinks.load_predictions(spark, f"{tmp_path}/out", "lists")
    assert sorted(values(back)) == [("a", "S2-5"), ("a", "S3-7")]
    with pytest.raises(ValueError):
        sinks.match_lists(m.withColumn("s1_id", F.lit("zz")), placed)
    for score in (0.5, 0.7):
        sinks.record_run(spark, f"{tmp_path}/runs", f"r{score}", {"macro_f05": score})
    assert [r.name for r in sinks.leaderboard(spark, f"{tmp_path}/runs").collect()] == ["r0.7", "r0.5"]


def test_grouped_and_tagged_files(spark, tmp_path):
    rows = [(f"S1-{k % 7}", f"S2-{k}", "us" if k % 3 else "fr") for k in range(70)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, tag string").repartition(5)
    sinks.write_grouped(df, f"{tmp_path}/grouped")
    back = spark.read.parquet(f"{tmp_path}/grouped").withColumn("file", F.input_file_name())
    assert sorted(values(back, "s1_id", "cand_id", "tag")) == sorted(rows)
    assert {r.n for r in back.groupBy("s1_id").agg(F.countDistinct("file").alias("n")).collect()} == {1}
    sinks.write_by_tag(df, f"{tmp_path}/tagged")
    assert {p.name for p in (tmp_path / "tagged").iterdir() if p.is_dir()} == {"tag=fr", "tag=us"}
    assert sorted(values(spark.read.parquet(f"{tmp_path}/tagged/tag=fr"), "s1_id", "cand_id")) == sorted(r[:2] for r in rows if r[2] == "fr")


def test_source_predicate_and_columns_reach_the_scan(spark, tmp_path):
    rows = [("S1-1", "US", "a"), ("S1-2", "FR", "b"), ("S1-3", None, "c")]
    spark.createDataFrame(rows, "entity_id string, country string, n_core string").write.parquet(f"{tmp_path}/s1")
    df = tables.read_source(spark, f"{tmp_path}/s1", ["US", "DE"], ["entity_id", "country"])
    assert values(df) == [("S1-1", "US")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(country, [DE,US])" in plan.replace("[US,DE]", "[DE,US]") and "n_core" not in plan
    assert tables.read_source(spark, f"{tmp_path}/s1").count() == 3 and tables.read_source(spark, f"{tmp_path}/s1", []).count() == 0


def test_tsv(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b"""\t\tUS\nS1-2\tNA\tx\t\n')
    rows = tables.read_tsv(spark, f"{tmp_path}/s.tsv", tables.RAW).collect()
    assert rows[0].business_name == 'a "b"' and rows[0].business_address == "" and rows[1].business_name == "NA" and rows[1].country == ""


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, r string")
    assert sorted(values(features.one_to_one(a, b, ["k"]))) == [(1, "x", "p"), (2, "y", "q")]
    for left, right in ((a, b.union(b)), (a.union(a), b), (b, a)):
        with pytest.raises(ValueError):
            features.one_to_one(left, right, ["k"])


def test_feature_groups_and_cosines(spark):
    assert [features.group_of(f) for f in ("ps_n", "twin_n", "sib_n", "house_lev", "ex_n", "s1_addr_c", "s1_name_c", "name_tset", "house_rel")] == ["G7", "G6", "G5", "G4", "G3", "G2", "G1", "base", "base"]
    assert features.without_groups(["ps_n", "twin_n", "name_tset"], "G7", "G6") == ["name_tset"]
    pairs, bands = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, cand_id string"), spark.createDataFrame([("a", "x", 0.5)], "s1_id string, cand_id string, cos double")
    assert sorted(values(features.with_cosines(pairs, bands, ["cos"])), key=str) == [("a", "x", 0.5), ("a", "y", None)]


def test_token_map_files(spark, tmp_path):
    mapping = spark.createDataFrame([("gret", "great", 3), ("phaum", "found", 4)], "src string, dst string, n int")
    models.save_token_map(mapping, f"{tmp_path}/map")
    assert sorted(values(models.load_token_map(spark, f"{tmp_path}/map"))) == [("gret", "great"), ("phaum", "found")]


def test_match_lists_in_first_seen_order(spark, spine):
    m = spark.createDataFrame([("a", "S3-9", 0), ("a", "S2-1", 1), ("a", "S3-9", 2), ("a", "S2-0", 3)], "s1_id string, match_id string, at int")
    got = {r.source1_entity_id: r.matched_entity_ids for r in sinks.match_lists(m, spine.withColumn("place", F.ascii("s1_id")), "at").collect()}
    assert got["a"] == "S3-9,S2-1,S2-0" and got["b"] == ""


def test_removal_is_by_md5_of_id_and_salt(spark):
    import hashlib

    s1 = spark.createDataFrame([(f"S1-{k}",) for k in range(300)], "entity_id string")
    got = {r.entity_id: r.removed for r in robust.removal_mask(s1, 0.3).collect()}
    assert got == {i: int(hashlib.md5(f"{i}|orphan".encode()).hexdigest(), 16) % 1000 / 1000 < 0.3 for i in got}


def test_rules_compared(spark, truth, spine):
    right, none = truth, truth.limit(0)
    got = {(r.rule, r.params): r.macro for r in decision.compare_rules({"thr": right}, {"thr": none}, truth, spine).collect()}
    assert got == {("thr", "tuned"): 1.0, ("thr", "frozen"): 0.5}


def test_expected_f05_keeps_the_best(spark):
    p = np.linspace(0.99, 0.01, 60)
    assert len(decision.expected_f05(p)) == 31 and decision.expected_f05(p)[5] == decision.expected_f05(p[:30])[5]


def test_thinning_takes_records_along(spark):
    s1 = spark.createDataFrame([(f"S1-{k}", "US" if k % 2 else "FR") for k in range(200)], "entity_id string, country string")
    pool = spark.createDataFrame([(f"S2-{k}", "US" if k % 2 else "FR") for k in range(300)], "entity_id string, country string")
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(200)], "s1_id string, match_id string")
    gone, records_ = robust.thinned(s1, pool, truth, spark.createDataFrame([("US", 0.5)], "country string, keep double"))
    gone, records_ = {r.entity_id for r in gone.collect()}, {r.entity_id for r in records_.collect()}
    assert 30 < len(gone) < 70 and all(int(i[3:]) % 2 for i in gone | records_)
    assert {i for i in records_ if int(i[3:]) < 200} == {"S2-" + i[3:] for i in gone} and any(int(i[3:]) >= 200 for i in records_)


def test_templated_streets_by_country(spark):
    s1 = spark.createDataFrame([(f"{c}{k}", c, f"road {w}") for c, word in (("x", "alpha"), ("y", "beta")) for k, w in enumerate([word] + [f"w{c}{k}" for k in range(9)])], "entity_id string, country string, a_street string")
    rows = [("x0", "p", "x", "road alpha", "road gamma"), ("x0", "q", "x", "road alpha", "alpha road 12"), ("x0", "r", "x", "road alpha", "road 7"), ("y0", "s", "y", "road beta", "kilo road")]
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, country string, a_street string, a_street_c string")
    assert sorted(values(evaluation.templated_streets(pairs, s1, 0.2), "s1_id", "cand_id")) == [("x0", "p"), ("y0", "s")]
    more = s1.union(spark.createDataFrame([(f"x{k}", "x", "gamma") for k in range(20, 30)], "entity_id string, country string, a_street string"))
    assert values(evaluation.templated_streets(pairs, more, 0.2), "s1_id", "cand_id") == [("y0", "s")]
