"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

Only DataFrame functions run on the executors. The driver handles one row for each source (weights are set by source,
so their number is a matter of configuration; more than `max_sources` raises) and one for each source and shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> list[float]:
    """Words wanted of each source, in order: the total shared by cycling weights; a target stops at `most` times its
    source's size and what is above is reshared among the others by weight until none is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    total, caps = float(sum(sizes)), [most * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        share = left / sum(w[k] for k in open_)
        over = [k for k in open_ if share * w[k] > caps[k]]
        if not over:
            for k in open_:
                out[k] = share * w[k]
            break
        for k in over:
            out[k] = caps[k]
            left -= caps[k]
            open_.remove(k)
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n items drawn without replacement from good + bad are good, at any size.

    Probabilities follow from their ratios on both sides of the mode; beyond 12 standard deviations and 60 they are below
    what a double holds, so no more of the range is looked at.
    """
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = int(12 * spread) + 60
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = (good - x[:-1]) * (n - x[:-1]) / ((x[:-1] + 1) * (bad - n + x[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(up))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(x[min(len(x) - 1, np.searchsorted(sums, rng.random() * sums[-1], "right"))])


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact blocks of each source for each output shard: (shards, sources).

    A node of the tree holds a range of shards and its blocks by source; a multivariate hypergeometric draw, source by
    source, gives the left half its share of the node's blocks, without replacement, so that every block has one shard.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def split(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        mid, rest = (low + high) // 2, int(held.sum())
        rng = np.random.default_rng([seed, low, high])
        n, left = rest * (mid - low) // (high - low), np.zeros_like(held)
        for k, mine in enumerate(held.tolist()):
            rest -= mine
            left[k] = hypergeometric(rng, mine, rest, n)
            n -= int(left[k])
        split(low, mid, left)
        split(mid, high, held - left)

    split(0, shards, np.array(counts, np.int64))
    return out


def fill(rows: DataFrame, group: str, order: list, size: str, passes: int) -> DataFrame:
    """rows with `took`: in each group and order, what fits into `left`, a few times over, as sums of prefixes; `left` is
    what stays open."""
    whole = Window.partitionBy(group)
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("took", F.lit(False))
    for _ in range(passes):
        fits = ~F.col("took") & (F.col(size) <= F.col("left"))
        rows = rows.withColumn("_sum", F.when(fits, F.sum(F.when(fits, F.col(size))).over(upto)))
        rows = rows.withColumn("_now", F.coalesce(F.col("_sum") <= F.col("left"), F.lit(False)))
        rows = rows.withColumn("left", F.col("left") - F.sum(F.when(F.col("_now"), F.col(size)).otherwise(0)).over(whole)).withColumn("took", F.col("took") | F.col("_now"))
    return rows.drop("_sum", "_now")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, shards: int = 16, block_docs: int = 64, max_sources: int = 100_000, sent_blocks: int = 100_000, passes: int = 4, seed: int = 23) -> DataFrame:
    """The mix of docs (doc_id, text, source): a row for each document.

    Columns: doc_id, size (words), source, source_size, target, taken (words taken, repeats counted), copies (whole
    repeats: an array of the output shard of each) and place (order within a shard). Sources are ordered by code
    point, null last, and weigh `weights` in turn. Each source is cut into blocks by a hash of the document: of
    `block_docs` documents, or of the root of their number where that is more, so that neither a source's blocks nor the
    documents of one block are ever more than one task's. Where a source's target is r times its size, all its blocks are taken floor(r) times and a permuted prefix of them once
    more, and the next three blocks are resolved by document. The taken blocks are split among the shards by
    split_quotas, dealt disjointly in permuted order, and shuffled locally by `place`. Up to `sent_blocks` blocks (some
    25 MB) go to the documents, which then stay where they are; beyond, documents go to their blocks.

    Null text: size 0, never more than floor(r) copies of nothing. Repeated rows stay together (same block, each
    counted). An empty table gives no rows. Everything is a hash of seed and content: reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = written(rows, "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = targets([r.source_size for r in found], weights, most)
    plan = []
    for k, r in enumerate(found):
        ratio = wanted[k] / r.source_size if r.source_size else 0.0
        whole = min(int(ratio + 1e-12), int(most))
        plan.append((k, r.source, r.source_size, wanted[k], whole, wanted[k] - whole * r.source_size, max(1, -(-r.docs // max(block_docs, math.isqrt(r.docs))))))
    plan_schema = "sid int, source string, source_size long, target double, whole int, rest double, blocks int"
    by_source = spark.createDataFrame(plan, plan_schema)  # max_sources rows at most: it goes to the rows, hot sources stay where they are

    rows = rows.withColumnRenamed("source", "s").join(F.broadcast(by_source), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int"))
    order = F.xxhash64(F.lit(seed), "sid", "block", F.lit("extra"))
    blocks = rows.groupBy("sid", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    blocks = fill(blocks.withColumn("left", F.col("rest")), "sid", [order, F.col("block")], "words", passes)
    nth = F.row_number().over(Window.partitionBy("sid").orderBy("took", order, "block"))
    blocks = blocks.withColumn("part", F.when(F.col("took"), 2).when((nth <= 3) & (F.col("left") > 0), 1).otherwise(0)).withColumnRenamed("left", "within")

    # every taken block, once for each time it is taken, gets its number in the source's permutation
    epochs = F.expr("filter(sequence(0, whole), e -> e < whole OR part > 0)")
    items = blocks.withColumn("epoch", F.explode(epochs)).withColumn("number", F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block", "epoch"), "block", "epoch")) - 1)
    items = written(items.select("sid", "block", "whole", "part", "within", "epoch", "number"), "mix-blocks")
    counts = {r.sid: r.n for r in items.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    quotas = split_quotas([counts.get(k, 0) for k in range(len(plan))], shards, seed)
    ends = np.cumsum(quotas, axis=0)
    bounds = spark.createDataFrame([(k, ends[:, k].tolist()) for k in range(len(plan))], "sid int, ends array<long>")
    items = items.join(bounds, "sid").withColumn("shard", F.expr("size(filter(ends, e -> e <= number))"))
    dealt = items.groupBy("sid", "block").agg(F.max("part").alias("part"), F.max("within").alias("within"), F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("items"))

    few = sum(blocks for *_, blocks in plan) <= sent_blocks
    out = rows.join(F.broadcast(dealt) if few else dealt, ["sid", "block"], "left")

    # a few blocks of each source are taken in part: in permuted order, what still fits is taken
    cut = fill(out.where("part = 1").withColumn("left", F.col("within")), "sid", [F.xxhash64("h", F.lit("cut")), F.col("h"), F.col("doc_id")], "size", passes)
    rest = out.where("coalesce(part, 0) <> 1").withColumn("extra", F.coalesce(F.col("part") == 2, F.lit(False)))
    out = rest.unionByName(cut.withColumnRenamed("took", "extra").select(*rest.columns))
    kept = F.when(F.col("extra"), F.col("items")).otherwise(F.expr("filter(items, i -> i.epoch < whole)"))
    out = out.withColumn("copies", F.transform(F.coalesce(kept, F.expr("array()")), lambda i: i["shard"]))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies", F.xxhash64("h", F.lit("place")).alias("place"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: docs' rows, repeated as the mix takes them, with columns mix_shard and mix_place.

    Rows that agree in doc_id, text and source have the same decision. Other columns may have any names; columns that are
    called mix_shard and mix_place already are replaced.
    """
    took = mix(docs, **how).groupBy("doc_id", "source", "place").agg(F.first("copies").alias("copies")).where(F.size("copies") > 0)
    took = took.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "place", F.explode("copies").alias("mix_shard"))
    seed = how.get("seed", 23)
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit("place")).alias("_place"))
    on = (F.col("_place") == F.col("place")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("mix_shard", "mix_place")]
    return left.join(took, on).select(*kept, "mix_shard", F.col("place").alias("mix_place"))
