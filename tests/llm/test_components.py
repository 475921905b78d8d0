import random

import pytest

from tessera.llm.components import components


@pytest.mark.parametrize("n", [20, 3000])
def test_chains_of_ascending_ids(spark, n):
    links = spark.createDataFrame([(k, k + 1) for k in range(n - 1)] + [(n + 5, n + 6)], "a long, b long")
    got = {r.id: r.comp for r in components(links).collect()}
    assert got == {k: 0 for k in range(n)} | {n + 5: n + 5, n + 6: n + 5}


def test_random_links_and_labels_to_start_from(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    up = list(range(300))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    got = {r.id: r.comp for r in components(df(links[130:]), components(df(links[:130]))).collect()}
    assert got == {k: root(k) for k in {x for pair in links for x in pair}}


def test_links_left_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(0, 1)], "a long, b long"), rounds=1)
