"""Token-ID / binary output: patched frame-of-reference files.

A file holds the ids of whole documents, one after the other, cut into blocks of 1024 values. Each block stores its
minimum, packs the differences at the width that covers a chosen percentile of them, and keeps the high bits of the
rest in an exception list (position, high bits). An index of block starts lets a reader decode any id range alone.

Layout, little-endian: magic, u32 block length, u64 ids, u64 blocks, u64 documents, u64 ids of earlier files of the
same part; u64 block starts [blocks + 1]; i64 doc ids, u8 "id is not null", u64 first id [documents]; blocks.
A block: u32 minimum, u16 width, u16 exceptions, u32 words [32 * width], u16 positions, u32 high bits.
Values are packed vertically: 32 lanes of 32 values, so packing and unpacking are 32 shifts of whole vectors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import default_tokenizer, encoder, new_path, small_batches, trim

MAGIC = b"TSRPFOR1"
HEAD = struct.Struct("<8sIQQQQ")
BLOCK = 1024
LANES = 32


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 1024) values below 2**width to (n, width * 32) words."""
    v, out = values.reshape(len(values), 32, LANES), np.zeros((len(values), max(width, 1), LANES), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, word] |= v[:, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, j] >> np.uint32(32 - shift)
    return out[:, :width].reshape(len(values), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w, out = words.reshape(len(words), width, LANES), np.zeros((len(words), 32, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(32 if width else 0):
        word, shift = divmod(j * width, 32)
        x = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | (w[:, word + 1] << np.uint32(32 - shift))
        out[:, j] = x & mask
    return out.reshape(len(words), BLOCK)


_short = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bit_lengths(d: np.ndarray) -> np.ndarray:
    return _short[d] if d.max(initial=0) < 1 << 16 else np.frexp(d.astype(np.float64))[1].astype(np.uint8)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], starts: list[int], before: int = 0, percentile: float = 90) -> bytes:
    """One file's bytes for ids (uint32), the documents' ids and where each starts."""
    n = len(ids)
    out: list[bytes] = []
    for at in range(0, n, BLOCK * 256):  # a part at a time: the work on it takes several times its memory
        out += _encode_blocks(ids[at : at + BLOCK * 256], percentile)
    index = np.cumsum([0, *map(len, out)]).astype("<u8")
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, BLOCK, n, len(out), len(doc_ids), before), index.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), valid.tobytes(), np.array(starts, "<u8").tobytes(), *out])


def _encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    blocks = -(-len(ids) // BLOCK)
    v = np.full(blocks * BLOCK, ids[-1], np.uint32)
    v[: len(ids)] = ids
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1)
    d = v - low[:, None]
    bits = bit_lengths(d)
    place = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    width = np.partition(bits, place, axis=1)[:, place]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for k, row in zip(at, _pack(d[at] & np.uint32((1 << int(w)) - 1), int(w)), strict=True):
            packed[k] = row.tobytes()
    row, where = np.nonzero(bits > width[:, None])
    high = (d[row, where] >> width[row].astype(np.uint32)).astype("<u4").tobytes()
    place_bytes = where.astype("<u2").tobytes()
    cuts = np.searchsorted(row, np.arange(blocks + 1)).tolist()
    heads = zip(low.tolist(), width.tolist(), packed, cuts[:-1], cuts[1:], strict=True)
    return [b"".join((struct.pack("<IHH", m, w, e - s), p, place_bytes[2 * s : 2 * e], high[4 * s : 4 * e])) for m, w, p, s, e in heads]


def decode_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray, int]:
    """Ids, document ids, starts with the end appended, ids of earlier files of the part."""
    magic, block, n, blocks, docs, before = HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token file of this format")
    at = HEAD.size
    index = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    at += 8 * (blocks + 1)
    ids = np.frombuffer(data, "<i8", docs, at)
    valid = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    starts = np.append(np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64), n)
    base = at + 17 * docs
    raw = np.frombuffer(data, np.uint8)
    starts_at = base + index[:-1]
    heads = raw[starts_at[:, None] + np.arange(8)]
    low, (width, extra) = heads[:, :4].copy().view("<u4")[:, 0], heads[:, 4:].copy().view("<u2").T.astype(np.int64)
    out = np.empty((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = np.array([np.frombuffer(data, "<u4", LANES * int(w), base + index[k] + 8) for k in rows], np.uint32)
        out[rows] = _unpack(words.reshape(len(rows), LANES * int(w)), int(w))
    block = np.repeat(np.arange(blocks), extra)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    at_exceptions = (starts_at + 8 + 4 * LANES * width)[block]
    where = raw[(at_exceptions + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
    high = raw[(at_exceptions + 2 * extra[block] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
    out[block, where] |= high << width[block].astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)[:n], [int(i) if ok else None for i, ok in zip(ids, valid, strict=True)], starts, before


def _put(uri: str, data: bytes) -> None:
    """Writes under a name of this attempt and renames: a repeated task leaves the same file."""
    from pyarrow import fs as pafs

    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, path)


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0, file_ids: int = 4_000_000, percentile: float = 90) -> DataFrame:
    """Encodes docs (doc_id, text), appends end_id to each, and writes files in ascending doc_id order under `out`.

    Rows are dealt to ranges of (doc_id, hash of text), nulls first; each task writes files of about file_ids ids (a
    document is never cut, so a longer one makes a longer file). Returns, lazily, a row for each file: part, file,
    n_docs, n_ids. A null text is an empty one; repeated rows and repeated or null doc_ids are all written.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.uint32(end_id).tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        names, starts, pieces, size, seq, before, rows = [], [], [], 0, 0, 0, []

        def flush() -> None:
            nonlocal names, starts, pieces, size, seq, before
            data = np.frombuffer(b"".join(pieces), np.uint32)
            _put(f"{out}/part-{part:06d}-{seq:06d}.tpf", encode_file(data, names, starts, before, percentile))
            rows.append((part, seq, len(names), size))
            names, starts, pieces, before, size, seq = [], [], [], before + size, 0, seq + 1

        for b in batches:
            for doc, null, text in zip(b["doc_id"], b["no_id"], b["text"], strict=True):
                ids = enc.encode(text) + end
                names.append(None if null else int(doc))
                starts.append(size)
                pieces.append(ids)
                size += len(ids) // 4
                if size >= file_ids:
                    flush()
        if names:
            flush()
        trim()
        yield pd.DataFrame(rows, columns=["part", "file", "n_docs", "n_ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return rows.mapInPandas(write, "part int, file int, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids]."""
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                ids, docs, starts, before = decode_file(data)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                ends = (4 * starts).tolist()
                crcs = [zlib.crc32(raw[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                out = pd.DataFrame({"part": int(name.rsplit("part-", 1)[1][:6]), "doc_id": pd.array(docs, "Int64"), "at": starts[:-1] + before, "n_tokens": np.diff(starts), "ids_crc32": crcs})
                yield out.assign(ids=np.split(ids.astype(np.int32), starts[1:-1])) if with_ids else out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tpf").load(path).select("path", "content")
    return files.mapInPandas(decode, schema)


def token_files(docs: DataFrame, out: str | None = None, **how) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32, a row for each document.

    Empty table: no rows. The ids of earlier parts are summed over a row for each part, not for each document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = out or new_path(spark, "token-files")
    manifest = f"{out}/manifest"
    write_token_files(docs, out, **how).write.parquet(manifest)
    sums = spark.read.parquet(manifest).groupBy("part").agg(F.sum("n_ids").alias("n"))
    if sums.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = {r.part: r.n for r in sums.collect()}  # a number for each part of the writing stage
    first, total = {}, 0
    for p in sorted(parts):
        first[p], total = total, total + parts[p]
    base = spark.createDataFrame(list(first.items()), "part int, base long")
    rows = read_token_files(spark, out).join(base, "part")
    return rows.select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
