"""The filtering stages against brute force, with null and repeated ids."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import mixing, packing, secrets, toxicity
from tests.llm.test_operators import linked, shingle_set


def table(rows):
    return Counter(tuple(r) for r in rows)


def test_near_duplicates_keep_one_row_of_each_component(spark, rows):
    text = dict(r for r in rows if r[0] is not None)
    more = [(1, text[1]), (1, text[1]), (2, text[3]), (None, text[4]), (None, text[5] + " x"), (None, "nowhere else are these six words"), (None, "nowhere else are these six words"), (None, None), (62, None)]
    every = rows + more
    full = [(i, t, "en", f"s{k % 3}", k) for k, (i, t) in enumerate(every)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    sets = [shingle_set(t) for _, t in every]
    roots = linked(sets)
    groups = {}
    for k, r in enumerate(roots):
        groups.setdefault(r if sets[k] else ("blank", k), []).append(k)
    kept = Counter(r.n_chars for r in got)
    assert max(kept.values()) == 1
    for members in groups.values():
        left = [k for k in members if k in kept]
        ids = [every[k][0] for k in members if every[k][0] is not None]
        assert len(left) == 1 and every[left[0]][0] == (min(ids) if ids else None)


def test_toxic_rows_go_by_their_own_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    bad = [i for i, p in found.items() if p == 1][:5]
    good = [i for i, p in found.items() if p == 0][:5]
    assert bad and good
    no_id = docs.where(F.col("doc_id").isin(bad + good)).withColumn("doc_id", F.lit(None).cast("long"))
    swapped = docs.where(F.col("doc_id").isin(good[:1])).withColumn("doc_id", F.lit(bad[0]))
    mixed = docs.unionByName(no_id).unionByName(swapped).unionByName(docs.where(F.col("doc_id").isin(good[1:2] + bad[1:2])))
    named = mixed.withColumn("_row", corpus_pipeline.row())
    scores = toxicity.score_toxicity(named, labels, key="_row").select("_row", "predicted").distinct().collect()
    verdict = {bytes(r._row): r.predicted for r in scores}
    assert len(verdict) == len(scores)
    want = Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in named.collect() if verdict[bytes(r._row)] == 0)
    got = table(corpus_pipeline.drop_toxic(spark, mixed, sf).collect())
    assert got == want
    kept = {(i, t) for i, t, *_ in got}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert (bad[0], texts[good[0]]) in kept and not any((None, texts[i]) in kept for i in bad)


def messy_docs(spark, rows):
    full = [(i, t, "en", None if k % 8 == 0 else f"s{k % 3}", len(t or ""), "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, mix_shard string"), full


def test_secrets_are_masked_in_every_row(spark, rows):
    docs, full = messy_docs(spark, [*rows, (None, 'x password = "hunter2hunter2" y'), (70, "passwd=abcdef7 z")])
    want = Counter()
    for i, t, lang, source, n, _ in full:
        spans = secrets.base_spans(t or "") + secrets.added_spans(t or "")
        hit = [any(s <= k < e for s, _, e in spans) for k in range(len(t or ""))]
        starts = {s for s, _, _ in spans if s == 0 or not hit[s - 1] or any(e == s for _, _, e in spans)}
        new = None if t is None else "".join("[SECRET]" if k in starts else "" if h else t[k] for k, h in enumerate(hit))
        want[(i, new, lang, source, len(new) if spans else n)] += 1
    got = corpus_pipeline.secret_scans(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS and table(got.collect()) == want


def test_mixed_rows_are_whole_rows_in_shards(spark, rows):
    docs, full = messy_docs(spark, rows)
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    took = Counter()
    for r in mixing.mix(docs).collect():
        took[(r.doc_id, r.source, r.size)] += len(r.copies)
    seen = Counter()
    for r in got.collect():
        assert tuple(r) in {x[:5] for x in full}
        seen[(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))] += 1
    assert seen == +took


def test_packing_deals_repeated_rows_to_different_groups(spark):
    docs = spark.createDataFrame([(1, "one row many times " * 20)] * 600 + [(None, "no id")], "doc_id long, text string").repartition(3)
    got = packing.pack(docs, group_docs=50).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 600 * got[0].doc_tokens or sum(r.length for r in got if r.doc_id == 1) % 600 == 0
    by_group = Counter(r.sequence_id >> 32 for r in got if r.start == 0)
    assert len(by_group) > 8 and max(by_group.values()) < 120
