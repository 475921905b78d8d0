"""Queries without SQL do the whole job on their base pairs and countries."""

import random

import pytest

from tessera.catalog import ORACLE_SQL, QUERIES
from tests.oracle import canon, connect

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rn", "lt", "mp", "st")]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Groups of 30 copies, so 20 pool records of one name, in two countries; one country without any copy."""
    rng, rows = random.Random(1), []
    for k in range(90):
        lang = ("en", "it", "pt")[k // 30]
        text = " ".join(rng.choices(WORDS, k=20)) if lang == "pt" else f"same{lang} " + " ".join(random.Random(lang).choices(WORDS, k=19))
        rows.append((k, text, lang, "web", len(text)))
    path = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["h_featurize"])
def test_large_groups_keep_their_pairs(spark, copies, name):
    got = {(r.s1_id, r.cand_id) for r in QUERIES[name](spark, copies).collect()}
    want = {(f"S1-{a}", f"S{1 + b % 3}-{b}") for lo in (0, 30) for a in range(lo, lo + 30, 3) for b in range(lo, lo + 30) if b % 3}
    assert want <= got


def test_every_country_is_left_out_once(spark, copies):
    got = QUERIES["m13_loco"](spark, copies).collect()
    assert {(r.trained_on, r.tested_on) for r in got} == {(a, b) for a in ("en", "it", "pt") for b in ("en", "it", "pt")} and len(got) == 9
    assert all(r.f_target is None and r.t_source is None for r in got if r.trained_on == "pt")


def test_twins_without_addresses_equal_sql(spark, tmp_path):
    """Names of five words leave no address: both sides of a comparison are empty strings."""
    texts = {0: "gorn balt dimp fest kurn", 1: "gorn balt dimp fest kurn some words of an address here", 2: "kurn balt dimp fest gorn"}
    rows = [(k, texts[k // 3 % 3], "en", "web", 7) for k in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = QUERIES["i6_twins"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["i6_twins"]).df()
    assert canon(got) == canon(want) and (want.twin_n > 0).any()
