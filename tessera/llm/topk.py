"""Exact top-k search by a bit-sliced index over quantised vectors.

A block of the index holds up to `block_rows` vectors in ascending vec_id. Component d of all its rows, made
non-negative by a constant, is stored as bit slices: slice i is a bitmap with bit i of every row. The inner product
with a query is a sum of slices shifted by the query's bits, done by carry-save adders on whole bitmaps (negative
query components use complemented slices; both only add a constant). The k best rows are then selected from the most
significant slice of the sum downward, and rows that tie at the boundary are resolved by vec_id.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE = 1024
LONG = 1 << 63


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python's integers where they need more bits."""
    if np.abs(x).max(initial=0) * scale < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    return np.array([math.floor(Fraction(y) * scale) for y in x.ravel().tolist()], object).reshape(x.shape)


def usable(column: str) -> F.Column:
    """Vectors that take part: not null, and no component null or not finite."""
    return F.col(column).isNotNull() & F.expr(f"forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def slices_of(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Integers (rows, dims) to bitmaps (dims, bits, words) of uint64, and the constant taken off."""
    low = int(rows.min(initial=0))
    v = rows - low if rows.dtype == object else (rows - low).astype(np.uint64)
    bits = max(1, int(v.max(initial=0)).bit_length())
    n, dims = v.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for i in range(bits):
        plane = ((v >> i) & 1 if v.dtype == object else (v >> np.uint64(i)) & np.uint64(1)).astype(np.uint8).T
        packed = np.packbits(plane, axis=1, bitorder="little")
        out[:, i, : packed.shape[1]] = packed
    return out.view(np.uint64), low


def rows_of(index: np.ndarray, low: int, numbers: np.ndarray) -> np.ndarray:
    """Some rows' integers, from their slices: (rows, dims)."""
    dims, bits, _ = index.shape
    kind = object if bits + abs(low).bit_length() > 60 else np.int64
    planes = (index[:, :, numbers // 64] >> (numbers % 64).astype(np.uint64)) & np.uint64(1)
    out = np.full((len(numbers), dims), low, kind)
    for i in range(bits):
        out += planes[:, i].T.astype(kind) << i
    return out


def product_slices(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least significant first, of the rows' inner products with a query, up to a constant."""
    bits = index.shape[1]
    waiting: dict[int, list[np.ndarray]] = {}
    size = np.abs(query)
    for j in range(int(size.max(initial=0)).bit_length()):
        chosen = ((size >> j) & 1).astype(bool)
        plus, minus = index[chosen & (query > 0)], index[chosen & (query < 0)]
        for i in range(bits):
            waiting.setdefault(i + j, []).extend([plus[:, i], ~minus[:, i]])
    out, weight = [], 0
    while waiting:
        todo = [x for x in waiting.pop(weight, []) if len(x)]
        rows = np.concatenate(todo) if todo else np.zeros((0, index.shape[2]), np.uint64)
        while len(rows) > 1:  # full adders take three slices of a weight, half adders two
            third = len(rows) // 3
            if third:
                a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
            else:
                total, carry, rest = rows[:1] ^ rows[1:2], rows[:1] & rows[1:2], rows[2:]
            waiting.setdefault(weight + 1, []).append(carry)
            rows = np.concatenate([total, rest])
        out.append(rows[0] if len(rows) else np.zeros(index.shape[2], np.uint64))
        weight += 1
    return out


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums: from the most significant slice downward, ties to smaller row numbers."""
    sure, tied = np.zeros_like(valid), valid.copy()
    need = min(k, int(np.bitwise_count(valid).sum()))
    for s in reversed(slices):
        ones = tied & s
        x = int(np.bitwise_count(sure | ones).sum())
        if x > need:
            tied = ones
        else:
            sure, tied = sure | ones, tied & ~s
            if x == need:
                tied = np.zeros_like(tied)
                break
    numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    first = numbers(sure)
    return np.concatenate([first, numbers(tied)[: need - len(first)]])


def search_block(ids: np.ndarray, index: np.ndarray, low: int, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of a block (ids ascending); a query's own row takes no part."""
    wide = max(index.shape[0], queries.shape[1])
    if index.shape[0] < wide:  # shorter vectors are padded with zeros
        bits = (-low).bit_length()
        pad = np.zeros((wide - index.shape[0], max(index.shape[1], bits), index.shape[2]), np.uint64)
        pad[:, :bits] = _constant(-low, len(ids), index.shape[2], bits)
        index = np.concatenate([np.pad(index, ((0, 0), (0, pad.shape[1] - index.shape[1]), (0, 0))), pad])
    queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
    valid = np.zeros(index.shape[2] * 64, np.uint8)
    valid[: len(ids)] = 1
    all_rows = np.packbits(valid, bitorder="little").view(np.uint64)
    out = []
    for q, query in zip(query_ids.tolist(), queries, strict=True):
        mask = all_rows
        if own := np.flatnonzero(ids == q).tolist():
            valid[own] = 0
            mask = np.packbits(valid, bitorder="little").view(np.uint64)
            valid[own] = 1
        best = select_top(product_slices(index, query), mask, k)
        rows = rows_of(index, low, best)
        for i, row in zip(ids[best].tolist(), rows, strict=True):
            out.append((q, i, sum(a * b for a, b in zip(row.tolist(), query.tolist(), strict=True))))
    return out


def _constant(value: int, n: int, words: int, bits: int) -> np.ndarray:
    """Slices (bits, words) of n rows that hold one value each."""
    ones = np.zeros(words * 64, np.uint8)
    ones[:n] = 1
    full = np.packbits(ones, bitorder="little").view(np.uint64)
    return np.array([full if value >> i & 1 else np.zeros_like(full) for i in range(bits)], np.uint64).reshape(bits, words)


def sort_key(score: int) -> bytes:
    """Bytes that are in the order of the scores, however large."""
    size = score if score >= 0 else -score
    n = (size.bit_length() + 7) // 8
    if score >= 0:
        return (32768 + n).to_bytes(2) + size.to_bytes(n)
    return (32767 - n).to_bytes(2) + ((1 << 8 * n) - 1 - size).to_bytes(n)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, block_rows: int = 16_384, chunk: int = 256) -> DataFrame:
    """Each query's k rows of largest integer inner product: query_id, rank (from 1), vec_id, score.

    vectors (vec_id, embedding), queries (query_id, embedding). Components become floor(scale * x), of any size; ranks are
    of the exact products, and a product beyond 64 bits is shown as the nearest long. Rows whose vec_id equals the query_id
    are not candidates. Vectors null or with null or non-finite components, and null ids, take no part; shorter vectors
    count as padded with zeros; repeated vec_ids are candidates each. The index is written to the shared folder once; each of
    its blocks meets each chunk of the stated queries once, as slices, and gives k rows.
    """
    v = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = queries.where(usable("embedding") & F.col("query_id").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    counts = v.count(), q.count()
    blocks, chunks = (max(1, -(-n // m)) for n, m in zip(counts, (block_rows, chunk), strict=True))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(chunks))

    def packed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        rows = np.zeros((len(b), max(map(len, b["v"]), default=0)))
        for k_, x in enumerate(b["v"]):
            rows[k_, : len(x)] = x
        index, low = slices_of(quantise(rows, scale))
        return pd.DataFrame({"part": [int(key[0])], "ids": [b["id"].to_numpy(np.int64).tobytes()], "dims": [index.shape[0]], "bits": [index.shape[1]], "low": [str(low)], "slices": [index.tobytes()]})

    schema = "part long, ids binary, dims int, bits int, low string, slices binary"
    index = v.select(block.alias("part"), F.col("vec_id").alias("id"), "v").groupBy("part").applyInPandas(packed, schema)
    index = written(index, "topk-index")
    asked = q.select(spread.alias("part"), F.col("query_id").alias("id"), "v").groupBy("part").applyInPandas(packed, schema)
    asked = written(asked, "topk-queries").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "dims", "bits", "low", "slices")])

    def unpacked(ids, dims, bits, low, slices):
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(slices, np.uint64).reshape(dims, bits, -(-len(ids) // 64)), int(low)

    def search(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                ids, slices, low = unpacked(r.ids, r.dims, r.bits, r.low, r.slices)
                q_ids, q_slices, q_low = unpacked(r.q_ids, r.q_dims, r.q_bits, r.q_low, r.q_slices)
                found = search_block(ids, slices, low, rows_of(q_slices, q_low, np.arange(len(q_ids))), q_ids, k)
                yield pd.DataFrame([(q, i, max(-LONG, min(LONG - 1, s)), sort_key(s)) for q, i, s in found], columns=["query_id", "vec_id", "score", "key"])

    # a joined row holds a block's slices; spark.sql.execution.arrow.maxBytesPerBatch bounds how many travel at once
    found = index.join(asked, "part").drop("part").mapInPandas(search, "query_id long, vec_id long, score long, key binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
