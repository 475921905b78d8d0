"""Suffix-array dedup: removes every byte that a repeated 200-byte string covers.

1. Winnowing picks, in every 200-byte string, one 32-byte anchor that depends on the string alone. A string that
   repeats has an anchor that repeats, so text around anchors that stand once needs no sorting. Anchors are counted over
   all documents: each unit of documents sends its distinct anchor hashes once, and gets back those that repeat.
2. For every repeated anchor, its context (the strings that picked it) goes to the shard of the anchor. An anchor with
   more contexts than a task should hold is spread over several shards.
3. Each shard sorts the suffixes of its distinct contexts (Larsson and Sadakane's refinement of groups by doubled
   ranks, in numpy) and finds the common prefixes of neighbours (Kasai's walk in text order, over all contexts in step).
   Neighbours with 200 common bytes are one string.
4. Strings of spread anchors are merged across shards: digests of each shard's distinct strings are looked up by binary
   search in the sorted digests of all shards.
5. The repeated strings go back to the documents by context, and cover their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_path, small_batches

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Positions in one buffer of step 1; longer documents are cut, overlapping by LENGTH - 1 bytes.
BUFFER = 1 << 21
PLACE = np.uint64((1 << 24) - 1)

_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(BUFFER + LENGTH + 2, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, from prefix sums of a polynomial with an invertible base."""
    up, down = _power_tables()
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: n + 1 - GRAM]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(parts: list[tuple[int, int, bytes]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts (document, offset, bytes) of at most BUFFER bytes together: (document, hashes, first string's start,
    number of strings) of the picked anchors. A string's anchor is its smallest gram hash, the last of equal ones."""
    buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    if len(buf) < LENGTH:
        return []
    h = gram_hashes(buf)
    low = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    step = 1
    while 2 * step <= WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if WINDOW > step:
        low = np.minimum(low[: len(low) - (WINDOW - step)], low[WINDOW - step :])
    pick = (PLACE - (low & PLACE)).astype(np.int64)
    out, at = [], 0
    for doc, offset, data in parts:
        n = len(data) - LENGTH + 1
        if n > 0:
            p = pick[at : at + n]
            first = np.flatnonzero(np.diff(p, prepend=-1))
            # minima are small numbers; times an odd number they are spread over the whole range again
            out.append((doc, h[p[first]] * MIX, (first + offset).astype(np.uint32), np.diff(np.append(first, n)).astype(np.uint8)))
        at += len(data)
    return out


ANCHOR = np.dtype([("h", "<u8"), ("lo", "<u4"), ("n", "u1")])


def _pack(h: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    out = np.empty(len(h), ANCHOR)
    out["h"], out["lo"], out["n"] = h, lo, n
    return out.tobytes()


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found: list[list[bytes]] = [[] for _ in range(len(b))]
        parts, held = [], 0

        def look() -> None:
            nonlocal parts, held
            for doc, *x in anchors(parts):
                found[doc].append(_pack(*x))  # noqa: B023
            parts, held = [], 0

        for k, text in enumerate(b["text"]):
            data = text.encode(errors="surrogatepass")
            for at in range(0, max(1, len(data) - LENGTH + 1), BUFFER - LENGTH):
                piece = data[at : at + BUFFER - 1] if len(data) > BUFFER else data
                if held + len(piece) > BUFFER:
                    look()
                parts.append((k, at, piece))
                held += len(piece)
                if len(data) <= BUFFER:
                    break
        look()
        yield pd.DataFrame({"doc_id": b["doc_id"], "sha": b["sha"], "n_bytes": b["n_bytes"], "anchors": [b"".join(x) for x in found]})


def _send(buckets: int, unit_anchors: int):
    """Units of unique documents: their rows (bucket -1), and the distinct anchor hashes of each by range."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pd.DataFrame:
            nonlocal seq, held, docs
            unit = (part << 24) + seq
            h, n = np.unique(np.frombuffer(b"".join(d[2] for d in docs), ANCHOR)["h"], return_counts=True)
            edges = np.searchsorted(h, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist() + [len(h)]
            rows = [(unit, -1, doc, sha, a) for doc, sha, a in docs]
            for b in range(buckets):
                x = slice(edges[b], edges[b + 1])
                if x.stop > x.start:
                    rows.append((unit, b, None, None, h[x].tobytes() + (n[x] > 1).astype(np.uint8).tobytes()))
            seq, held, docs = seq + 1, 0, []
            return pd.DataFrame(rows, columns=["unit", "bucket", "doc_id", "sha", "data"]).astype({"doc_id": "Int64"})

        for b in batches:
            for doc, sha, a in zip(b["doc_id"], b["sha"], b["anchors"], strict=True):
                docs.append((None if pd.isna(doc) else int(doc), sha, bytes(a)))
                held += len(a) // ANCHOR.itemsize
                if held >= unit_anchors:
                    yield flush()
        if docs:
            yield flush()

    return send


def _repeated(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Back to each unit: those of its hashes that stand at two places of the corpus."""
    sent = [np.frombuffer(x, np.uint64, len(x) // 9) for x in b["data"]]
    twice = [np.frombuffer(x, np.uint8, offset=len(x) // 9 * 8) for x in b["data"]]
    values, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    again = np.bincount(inverse, 1 + np.concatenate(twice)) > 1
    ends = np.cumsum([0, *map(len, sent)])
    return pd.DataFrame({"unit": b["unit"], "again": [x[again[inverse[s:e]]].tobytes() for x, s, e in zip(sent, ends[:-1], ends[1:], strict=True)]})


def _kept_anchors(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    again = np.sort(np.frombuffer(b"".join(replies["again"]), np.uint64))
    rows = []
    for doc, sha, data in zip(docs["doc_id"], docs["sha"], docs["data"], strict=True):
        a = np.frombuffer(data, ANCHOR)
        if len(a) and len(again):
            where = np.minimum(np.searchsorted(again, a["h"]), len(again) - 1)
            a = a[again[where] == a["h"]]
            if len(a):
                rows.append((doc, sha, a.tobytes()))
    return pd.DataFrame(rows, columns=["doc_id", "sha", "anchors"]).astype({"doc_id": "Int64"})


PLACES = np.dtype([("ctx", "V16"), ("lo", "<u4"), ("n", "u1")])


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with the places of their contexts (ctx null), and the distinct contexts of a batch with their number."""
    for b in batches:
        seen: dict[bytes, list] = {}
        rows = []
        for sha, text, data in zip(b["sha"], b["text"], b["anchors"], strict=True):
            raw, a = text.encode(errors="surrogatepass"), np.frombuffer(data, ANCHOR)
            places = np.empty(len(a), PLACES)
            places["lo"], places["n"] = a["lo"], a["n"]
            ids = []
            for h, lo, n in zip(a["h"].tolist(), a["lo"].tolist(), a["n"].tolist(), strict=True):
                c = raw[lo : lo + n - 1 + LENGTH]
                i = blake2b(c, digest_size=16).digest()
                ids.append(i)
                if i in seen:
                    seen[i][2] += 1
                else:
                    seen[i] = [h, c, 1]
            places["ctx"] = np.frombuffer(b"".join(ids), "V16")
            rows.append((sha, raw, places.tobytes()))
        docs = pd.DataFrame(rows, columns=["sha", "raw", "places"])
        signed = np.array([x[0] for x in seen.values()], np.uint64).astype(np.int64)
        ctxs = pd.DataFrame({"ctx": list(seen), "h": signed, "n": [x[2] for x in seen.values()], "raw": [x[1] for x in seen.values()]})
        yield docs.assign(ctx=None, h=pd.NA, n=pd.NA).astype({"h": "Int64", "n": "Int64"})
        yield ctxs.assign(sha=None, places=None)[["sha", "raw", "places", "ctx", "h", "n"]]


def suffix_array(text: np.ndarray, ends: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of texts laid end to end; ends[i] is the end of the text that position i is in.

    The first keys are seven bytes and how many there are; then, as Larsson and Sadakane do, only groups of suffixes
    that are still alike are sorted again, by the ranks of the suffixes `depth` further on. Equal suffixes of
    different texts stay in text order.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    left = ends - np.arange(n)
    key = np.minimum(left, 7).astype(np.uint64)
    for k in range(7):
        byte = padded[k : k + n] << np.uint64(56 - 8 * k)
        key |= np.where(left > k, byte, np.uint64(0))
    sa = np.argsort(key, kind="stable")
    fresh = np.diff(key[sa], prepend=~key[sa[:1]]) != 0
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    depth = 7
    while len(slots) and depth < deepest:
        at = sa[slots]
        beyond = at + depth
        second = np.where(beyond < ends[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[slots] = at
        fresh = np.diff(key, prepend=-1) != 0
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Kasai's walk: common prefix, up to `most`, of each suffix with the one before it in the suffix array.

    Going one position on in a text lowers the length by one at most. All texts take a step together; bytes are
    compared eight at a time.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(most + 8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + most, np.uint64)
    for k in range(8):
        words |= wide[k : k + n + most] << np.uint64(56 - 8 * k)
    ends = np.repeat(starts + lengths, lengths)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    lcp = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    live = len(starts)
    for t in range(int(lengths.max(initial=0))):
        while lengths[live - 1] <= t:
            live -= 1
        i = starts[:live] + t
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        top = np.minimum(np.minimum(ends[i] - i, ends[j] - j), most)
        top[r == 0] = 0
        now = np.minimum(np.maximum(h[:live] - 1, 0), top)
        todo = np.flatnonzero(now < top)
        while len(todo):
            x = words[i[todo] + now[todo]] ^ words[j[todo] + now[todo]]
            same = sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8)) + (x == 0)
            now[todo] = np.minimum(now[todo] + same, top[todo])
            todo = todo[(x == 0) & (now[todo] < top[todo])]
        lcp[r] = now
        h[:live] = now
    return lcp


def shard_strings(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of a shard's contexts: (context, string's place, class, how often) of every string."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    sa, rank = suffix_array(text, ends, int(lengths.max()) + 1)
    lcp = common_prefixes(text, starts, lengths, sa, rank)
    owner = np.repeat(np.arange(len(contexts)), lengths)
    whole = ends[sa] - sa >= LENGTH
    # between two strings of one class all suffixes have LENGTH bytes in common, so they are whole
    cls = np.cumsum(lcp < LENGTH)[whole]
    at = sa[whole]
    return owner[at], at - starts[owner[at]], cls, np.bincount(cls, counts[owner[at]])[cls]


def _bits(ctx: np.ndarray, place: np.ndarray, ids: list[bytes], sizes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Repeated strings of each context as packed bits."""
    out = []
    order = np.argsort(ctx, kind="stable")
    ctx, place = ctx[order], place[order]
    cuts = np.flatnonzero(np.diff(ctx, prepend=-1))
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ctx)], strict=True):
        flags = np.zeros(int(sizes[ctx[s]]), np.uint8)
        flags[place[s:e]] = 1
        out.append((ids[ctx[s]], np.packbits(flags).tobytes()))
    return out


def _shard(buckets: int):
    def shard(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """Rows (ctx, bits) of contexts with repeated strings, and digests of spread anchors' strings by range."""
        b = b.groupby("ctx", sort=False).agg(h=("h", "first"), n=("n", "sum"), raw=("raw", "first"), spread=("spread", "first")).reset_index()
        per = b.groupby("h")["ctx"].transform("size")
        alone = (per == 1) & ~b["spread"]
        done = b[alone & (b["n"] > 1)]
        out = [(c, np.packbits(np.ones(len(r) - LENGTH + 1, np.uint8)).tobytes(), None) for c, r in zip(done["ctx"], done["raw"], strict=True)]
        b = b[~alone].reset_index(drop=True)
        if len(b):
            ids, raw = [bytes(x) for x in b["ctx"]], [bytes(x) for x in b["raw"]]
            sizes = np.array([len(r) - LENGTH + 1 for r in raw])
            ctx, place, cls, often = shard_strings(raw, b["n"].to_numpy(np.int64))
            out += [(i, x, None) for i, x in _bits(ctx[often > 1], place[often > 1], ids, sizes)]
            spread = b["spread"].to_numpy(bool)
            one = np.flatnonzero(np.diff(cls, prepend=-1) != 0)
            one = one[spread[ctx[one]]]
            if len(one):
                marks = np.frombuffer(b"".join(blake2b(raw[c][p : p + LENGTH], digest_size=16).digest() for c, p in zip(ctx[one].tolist(), place[one].tolist(), strict=True)), ">u8").reshape(-1, 2)
                rows = np.empty(len(one), STRING)
                rows["mark"], rows["ctx"], rows["place"], rows["open"] = marks.astype(np.uint64), ctx[one], place[one], often[one] < 2
                rows = rows[np.lexsort((rows["mark"][:, 1], rows["mark"][:, 0]))]
                edges = np.searchsorted(rows["mark"][:, 0], np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)).tolist() + [len(rows)]
                for k in range(buckets):
                    part = rows[edges[k] : edges[k + 1]]
                    if len(part):
                        used, part["ctx"] = np.unique(part["ctx"], return_inverse=True)
                        head = b"".join(ids[c] + int(sizes[c]).to_bytes(1, "little") for c in used)
                        out.append((len(used).to_bytes(4, "little") + head, part.tobytes(), k))
        return pd.DataFrame(out, columns=["ctx", "bits", "bucket"]).astype({"bucket": "Int64"})

    return shard


STRING = np.dtype([("mark", "<u8", (2,)), ("ctx", "<u4"), ("place", "u1"), ("open", "u1")])


def _merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """One range of digests from all shards: an open string repeats if binary search finds its digest twice."""
    runs = [np.frombuffer(x, STRING) for x in b["bits"]]
    every = np.concatenate([r["mark"] for r in runs])
    out = []
    full = every[np.lexsort((every[:, 1], every[:, 0]))]
    starts = np.flatnonzero(np.any(np.diff(full, axis=0, prepend=~full[:1]) != 0, axis=1))
    sizes = np.diff(np.append(starts, len(full)))
    uniq = full[starts]
    for head, r in zip(b["ctx"], runs, strict=True):
        n = int.from_bytes(head[:4], "little")
        ids = [bytes(head[4 + 17 * k : 20 + 17 * k]) for k in range(n)]
        size = np.array([head[20 + 17 * k] for k in range(n)], np.int64)
        mine = r[r["open"] == 1]
        lo, hi = (np.searchsorted(uniq[:, 0], mine["mark"][:, 0], side) for side in ("left", "right"))
        at = lo.copy()
        for k in np.flatnonzero(hi - lo > 1):
            at[k] = lo[k] + np.searchsorted(uniq[lo[k] : hi[k], 1], mine["mark"][k, 1])
        mine = mine[sizes[at] > 1]
        if len(mine):
            out += _bits(mine["ctx"].astype(np.int64), mine["place"].astype(np.int64), ids, size)
    return pd.DataFrame(out, columns=["ctx", "bits"])


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for sha, raw, found in zip(b["sha"], b["raw"], b["found"], strict=True):
            change = np.zeros(len(raw) + 1, np.int64)
            for x in found:
                at = x["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8)))
                np.add.at(change, at, 1)
                np.add.at(change, at + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            rows.append((sha, int(gone.sum()), spans, sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["sha", "n_removed", "n_spans", "kept_sha256"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dedup(docs: DataFrame, unit_anchors: int = 200_000, shard_bytes: int = 3_000_000, spread_over: int = 512, few: int = 100_000, hot: int = 1000) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty. A text that stands twice, of 200 bytes or more, goes whole; it still counts
    as a place of its strings for others. Texts below 200 bytes lose nothing. Repeated and null doc_ids are rows like
    others; an empty table gives no rows. `few` bounds the table of spread anchors that is broadcast; a larger one is
    joined. A text of more than `hot` copies, and a ten-thousandth of all rows, is joined by broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = _stored(text.mapInPandas(_find_anchors, "doc_id long, sha string, n_bytes long, anchors binary"), "dedup-anchors")
    buckets = int(min(1 << 16, max(64, docs.count() // 4000)))

    one = rows.where(F.octet_length("anchors") > 0).dropDuplicates(["sha"]).select("doc_id", "sha", "anchors")
    units = _stored(one.mapInPandas(_send(buckets, unit_anchors), "unit long, bucket int, doc_id long, sha string, data binary"), "dedup-units")
    replies = units.where("bucket >= 0").select("unit", "bucket", "data").groupBy("bucket").applyInPandas(_repeated, "unit long, again binary")
    owners = units.where("bucket < 0").select("unit", "doc_id", "sha", "data")
    kept = owners.groupBy("unit").cogroup(replies.groupBy("unit")).applyInPandas(_kept_anchors, "doc_id long, sha string, anchors binary")
    kept = kept.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), "anchors")
    found = text.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))).select("sha", "text", "anchors")
    found = _stored(found.mapInPandas(_contexts, "sha string, raw binary, places binary, ctx binary, h long, n long"), "dedup-contexts")

    contexts = found.where("ctx IS NOT NULL").select("ctx", "h", "n", "raw")
    total = contexts.agg(F.sum(F.octet_length("raw")).alias("b")).first().b or 0
    shards = max(1, int(total // shard_bytes))
    many = contexts.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > spread_over)
    many = many.select("h", F.ceil(F.col("c") / spread_over).cast("int").alias("ways"))
    if many.limit(few + 1).count() <= few:
        many = F.broadcast(many)  # at most `few` rows of 12 bytes
    # contexts of frequent anchors are counted where they are before they travel: one common passage is a row for each task
    hot_ones = contexts.join(many, "h").groupBy("ctx").agg(F.first("h").alias("h"), F.sum("n").alias("n"), F.first("raw").alias("raw"), F.first("ways").alias("ways"))
    contexts = contexts.join(many, "h", "left_anti").withColumn("ways", F.lit(None).cast("int")).unionByName(hot_ones)
    contexts = contexts.withColumn("spread", F.col("ways").isNotNull())
    way = F.when(F.col("spread"), F.pmod(F.xxhash64("ctx"), F.col("ways"))).otherwise(F.lit(0))
    contexts = contexts.withColumn("shard", F.pmod(F.xxhash64("h", way), F.lit(shards)))
    sorted_ = contexts.groupBy("shard").applyInPandas(_shard(buckets), "ctx binary, bits binary, bucket long")
    sorted_ = _stored(sorted_, "dedup-shards")
    merged = sorted_.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(_merge, "ctx binary, bits binary")
    bits = sorted_.where("bucket IS NULL").select("ctx", "bits").unionByName(merged)

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sha, data in zip(b["sha"], b["places"], strict=True):
                p = np.frombuffer(data, PLACES)
                out.append(pd.DataFrame({"sha": sha, "ctx": [x.tobytes() for x in p["ctx"]], "lo": p["lo"].astype(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"sha": [], "ctx": [], "lo": []})

    owned = found.where("ctx IS NULL").select("sha", "places").mapInPandas(unfold, "sha string, ctx binary, lo long")
    hits = owned.join(bits, "ctx").groupBy("sha").agg(F.collect_list(F.struct("lo", "bits")).alias("found"))
    cover = found.where("ctx IS NULL").select("sha", "raw").dropDuplicates(["sha"]).join(hits, "sha")
    cover = cover.mapInPandas(_cover, "sha string, n_removed long, n_spans long, kept_sha256 string")

    # a text that stands twice is known from digests alone; the few texts of very many copies (at most 10,000 digests,
    # each of a ten-thousandth of the rows or more) are broadcast, so that none of them is one task's
    least = max(hot, rows.count() // 10_000)
    copies = _stored(rows.groupBy("sha").agg(F.count("*").alias("copies")), "dedup-copies")
    named, many = rows.select("doc_id", "sha", "n_bytes"), F.broadcast(copies.where(F.col("copies") > least))
    rest = named.join(many.select("sha"), "sha", "left_anti").join(copies, "sha").join(cover, "sha", "left")
    out = rest.unionByName(named.join(many, "sha"), allowMissingColumns=True)
    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = F.lit(sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twice, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
