"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct five-word shingles as 64-bit hashes. All shingles have one global order: those whose
hash lies in the lowest `SHARE` of the range by document frequency (counted over all documents), the others after
them by hash. Two sets with Jaccard similarity of 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles in
this order, and a document with that many shingles of its own alone can have no partner. The few documents that are
left meet in groups of one shared prefix shingle; each group stores its sets in a prefix tree, most frequent shingles
first, and walks it once for all its members: overlaps are kept for each tree node and shared by the sets below it, and
a subtree is left as soon as the remaining lengths cannot lift any member's overlap to what a link needs.

Only links between different components matter, so a group whose members are all connected is skipped, and a group too
large for one task is first cut at random and then compared across its components only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written
from tessera.llm.components import components

N = 5
#: Part of the hash range whose shingles' document frequencies are counted; above 0.2, so that prefixes fit in.
SHARE = 0.34
TOP = np.uint64(int(SHARE * 2**64))
#: A shingle on so many documents of one unit travels once for the unit.
HOT = 16
OTHER = 127
A, M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z in lower case, words between ASCII white space."""
    split = text.encode(errors="surrogatepass").lower().split() if text else []
    w = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = len(w)
    if n == 0:
        return w
    k = min(N, n)
    h = w[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        h = h * A + w[i : n - k + 1 + i]
    h ^= h >> np.uint64(29)
    h *= M
    h ^= h >> np.uint64(32)
    return np.unique(h)


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def six(x: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _units(docs: DataFrame, buckets: int, unit_tokens: int, key: str | None = None) -> DataFrame:
    """Rows of two kinds. Documents (bucket -1): unit, at, doc_id, digest, n, n_low, rest, key, hot. Messages: unit, bucket,
    low hashes with the documents that hold them, and hashes on HOT or more documents of the unit with their number."""
    limit = int(TOP >> np.uint64(16)) + 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seq = Words(), TaskContext.get().partitionId(), 0
        meta: list[list] = []
        lows: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal meta, lows, held, seq
            unit = (part << 24) + seq
            seq += 1
            t = np.concatenate([*lows, np.zeros(0, np.uint64)]) >> np.uint64(16)
            at = np.repeat(np.arange(len(lows), dtype=np.uint32), [len(x) for x in lows])
            order = np.argsort(t, kind="stable")
            t, at = t[order], at[order]
            first = np.flatnonzero(np.diff(t, prepend=np.uint64(2**63)) != 0)
            count = np.diff(np.append(first, len(t)))
            hot = np.repeat(count >= HOT, count)
            ht, hat = t[hot], at[hot]
            by_doc = np.argsort(hat, kind="stable")
            ends = np.searchsorted(hat[by_doc], np.arange(len(lows) + 1))
            for k, row in enumerate(meta):
                row.append(six(ht[by_doc[ends[k] : ends[k + 1]]]))
            t, at = t[~hot], at[~hot]
            hot_t, hot_n = np.unique(ht), count[count >= HOT]
            edges = np.array([b * limit // buckets for b in range(buckets + 1)], np.uint64)
            edges[-1] = limit
            cut, hot_cut = np.searchsorted(t, edges), np.searchsorted(hot_t, edges)
            rows = [(unit, -1, *row, b"", b"", b"", b"") for row in meta]
            for b in range(buckets):
                x, y = slice(cut[b], cut[b + 1]), slice(hot_cut[b], hot_cut[b + 1])
                if x.stop > x.start or y.stop > y.start:
                    rows.append((unit, b, 0, None, b"", 0, 0, b"", None, b"", six(t[x]), at[x].tobytes(), six(hot_t[y]), hot_n[y].astype(np.uint32).tobytes()))
            meta, lows, held = [], [], 0
            return pd.DataFrame(rows, columns=["unit", "bucket", "at", "doc_id", "digest", "n", "n_low", "rest", "key", "hot", "low", "low_at", "hot_low", "hot_n"]).astype({"doc_id": "Int64"})

        for b in batches:
            for doc, text, row in zip(b["doc_id"], b["text"], b["key"], strict=True):
                s = shingles(text, words)
                n, low = len(s), int(np.searchsorted(s, TOP))
                rest = s[low : max(low, prefix_length(n))] if n else s
                meta.append([len(meta), None if pd.isna(doc) else int(doc), digest(s), n, low, six(rest >> np.uint64(16)), row])
                lows.append(s[:low])
                held += low
                if held >= unit_tokens:
                    yield flush()
        if meta:
            yield flush()

    schema = "unit long, bucket int, at int, doc_id long, digest binary, n int, n_low int, rest binary, key binary, hot binary, low binary, low_at binary, hot_low binary, hot_n binary"
    return docs.select("doc_id", "text", (F.col(key) if key else F.lit(None).cast("binary")).alias("key")).mapInPandas(scan, schema)


def _frequencies(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """For one range of hashes: the document frequency of each, sent back to the units where it exceeds one."""
    t = [from_six(x) for x in b["low"]]
    hot = [from_six(x) for x in b["hot_low"]]
    n = [np.frombuffer(x, np.uint32).astype(np.int64) for x in b["hot_n"]]
    every = np.concatenate([*t, *hot])
    weight = np.concatenate([np.ones(sum(map(len, t)), np.int64), *n])
    values, inverse = np.unique(every, return_inverse=True)
    df = np.bincount(inverse, weight, len(values))
    code = np.where(df > 1, np.clip((8 * np.log2(np.maximum(df, 1))).astype(np.int64), 1, OTHER - 1), 0).astype(np.uint64)
    keys = (code << np.uint64(48)) | values
    rows, at, hot_at = [], 0, sum(map(len, t))
    for unit, x, y, where in zip(b["unit"], t, hot, b["low_at"], strict=True):
        k = keys[inverse[at : at + len(x)]]
        shared = k >> np.uint64(48) > 0
        rows.append((unit, k[shared].tobytes(), np.frombuffer(where, np.uint32)[shared].tobytes(), keys[inverse[hot_at : hot_at + len(y)]].tobytes()))
        at, hot_at = at + len(x), hot_at + len(y)
    return pd.DataFrame(rows, columns=["unit", "keys", "key_at", "hot_keys"])


def _survivors(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """Documents of a unit that may have a partner, with their shared low shingles in global order and their prefix."""
    keys = np.frombuffer(b"".join(replies["keys"]), np.uint64)
    at = np.frombuffer(b"".join(replies["key_at"]), np.uint32)
    hot = np.sort(np.frombuffer(b"".join(replies["hot_keys"]), np.uint64))
    hot = hot[np.argsort(hot & np.uint64(2**48 - 1))]
    hot_t = hot & np.uint64(2**48 - 1)
    order = np.lexsort((keys, at))
    keys, at = keys[order], at[order]
    docs = docs.sort_values("at")
    cuts = np.searchsorted(at, np.arange(len(docs) + 1))
    rows = []
    for k, (doc, sha, n, n_low, rest, its_hot) in enumerate(zip(docs["doc_id"], docs["digest"], docs["n"], docs["n_low"], docs["rest"], docs["hot"], strict=True)):
        wanted = prefix_length(n) - (n_low - (cuts[k + 1] - cuts[k]) - len(its_hot) // 6)
        if n and wanted > 0:
            own = np.sort(np.concatenate([keys[cuts[k] : cuts[k + 1]], hot[np.searchsorted(hot_t, from_six(its_hot))]]))
            prefix = np.concatenate([own, from_six(rest) | np.uint64(OTHER << 48)])[:wanted]
            rows.append((None if pd.isna(doc) else int(doc), sha, n, own.tobytes(), prefix.astype(np.int64)))
    return pd.DataFrame(rows, columns=["doc_id", "digest", "n", "shared", "prefix"]).astype({"doc_id": "Int64"})


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole sets in global order: 7 bits of frequency and 56 of hash."""
    words = Words()
    for b in batches:
        rows = []
        for node, sha, text, shared in zip(b["id"], b["digest"], b["text"], b["shared"], strict=True):
            s = shingles(text, words)
            if digest(s) != sha:  # another row with this doc_id
                continue
            known = np.frombuffer(shared, np.uint64)
            known = known[np.argsort(known & np.uint64(2**48 - 1))]
            t = s >> np.uint64(16)
            code = np.where(s < TOP, 0, OTHER).astype(np.uint64)
            if len(known):
                where = np.minimum(np.searchsorted(known & np.uint64(2**48 - 1), t), len(known) - 1)
                hit = ((known[where] & np.uint64(2**48 - 1)) == t) & (s < TOP)
                code[hit] = known[where[hit]] >> np.uint64(48)
            rows.append((node, np.sort((code << np.uint64(56)) | (s >> np.uint64(8))).tobytes()))
        yield pd.DataFrame(rows, columns=["id", "keys"])


def tree_links(sets: list[np.ndarray], comp: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is connected among sets (ascending key arrays) of different components.

    The sets, each turned to descending keys and sorted, are the leaves of a prefix tree with whole runs of keys on its
    edges. overlap[x] at a node is the size of set x's intersection with the path to it.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = len(vocabulary) - 1 - flat
    ends = np.cumsum(size)
    paths = [np.sort(flat[e - n : e]) for e, n in zip(ends, size, strict=True)]
    order = sorted(range(m), key=lambda k: paths[k].astype(">u4").tobytes())
    member = np.zeros((len(vocabulary), m), bool)
    for k, p in enumerate(paths):
        member[p, k] = True
    parent, group = list(range(m)), {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, c in enumerate(comp):
        parent[k] = group.setdefault(c, k)
    links = []
    todo = [(0, m, 0, np.zeros(m, np.int64), np.arange(m))]
    while todo:
        lo, hi, depth, overlap, active = todo.pop()
        first, last = paths[order[lo]], paths[order[hi - 1]]
        short = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:short] != last[depth:short])
        to = depth + int(differ[0]) if len(differ) else short
        if to > depth:
            overlap = overlap + member[first[depth:to]][:, active].sum(axis=0)
        below = order[lo:hi]
        roots = {root(k) for k in below}
        one = roots.pop() if len(roots) == 1 else None
        longest, least = int(size[below].max()), int(size[below].min())
        n = size[active]
        # the best that any leaf below can reach with x: what is shared so far and the shorter rest
        best = overlap + np.minimum(n - overlap, longest - to)
        keep = 9 * best >= 4 * (n + np.maximum(least, best))
        if one is not None:
            keep &= np.array([root(int(k)) != one for k in active], bool)
        overlap, active = overlap[keep], active[keep]
        if not len(active):
            continue
        while lo < hi and len(paths[order[lo]]) == to:  # ends here
            y = order[lo]
            hit = (9 * overlap >= 4 * (size[active] + size[y])) & (active != y)
            for x in active[hit].tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[a] = b
                    links.append((x, y))
            lo += 1
        if lo < hi:
            heads = np.array([paths[k][to] for k in order[lo:hi]])
            starts = lo + np.flatnonzero(np.diff(heads, prepend=-1))
            todo += [(int(a), int(b), to, overlap, active) for a, b in zip(starts, [*starts[1:], hi], strict=True)]
    return links


def _group_links(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    b = b.drop_duplicates("id")
    ids = b["id"].tolist()
    found = tree_links([np.frombuffer(x, np.uint64) for x in b["keys"]], b["comp"].tolist())
    return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"])


def _blocks(rows: int, tokens: int) -> F.Column:
    """Tasks' worth of a group: by its rows and by their shingles."""
    return F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("tokens") / tokens)).cast("int")


def jaccard_components(docs: DataFrame, unit_tokens: int = 1_000_000, rows: int = 128, tokens: int = 60_000, family: int = 16_384, key: str | None = None) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links of Jaccard similarity 0.8 or more, itself included. Texts
    null or without words have no shingles and their own doc_id; texts of fewer than five words have one shingle, the
    whole. Equal sets are one class and linked, however many rows have them. Null doc_ids are members, but never a
    component's name unless it has no other. Repeated rows give repeated rows; an empty table gives none. key names a binary
    column of docs that goes along with each row, with the row's class: rows of one component, and no others, share one.
    """
    small_batches(docs.sparkSession)
    buckets = int(min(1 << 20, max(256, docs.count() // 1000)))
    units = written(_units(docs, buckets, unit_tokens, key), "jaccard-units")
    name = key
    meta = units.where("bucket < 0").select("unit", "at", "doc_id", "digest", "n", "n_low", "rest", "hot")
    messages = units.where("bucket >= 0").select("unit", "bucket", "low", "low_at", "hot_low", "hot_n")
    replies = messages.groupBy("bucket").applyInPandas(_frequencies, "unit long, keys binary, key_at binary, hot_keys binary")
    schema = "doc_id long, digest binary, n int, shared binary, prefix array<long>"
    left = meta.groupBy("unit").cogroup(replies.groupBy("unit")).applyInPandas(_survivors, schema)
    left = left.dropDuplicates(["digest"]).withColumn("id", F.monotonically_increasing_id())
    left = written(left, "jaccard-left")

    # sets link only within a factor of 1.25 in size, so a shingle's group is cut by size: a set stands in its own size
    # class and the next. Groups of the same members are one group.
    key = left.select(F.explode("prefix").alias("shingle"), "id", "n").distinct()
    size_class = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
    key = key.withColumn("class", F.explode(F.array(size_class, size_class + 1))).withColumn("key", F.xxhash64("shingle", "class"))
    many = key.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.min("id").alias("least"), *[F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in (0, 1)]).where("rows > 1")
    many = many.groupBy("rows", "tokens", "least", "m0", "m1").agg(F.min("key").alias("key")).select("key", "rows", "tokens", "least")
    many = written(many, "jaccard-shared")  # read plainly, so that a hot key of the join below can be split
    key = written(key.select("key", "shingle", "id", "n").join(many, "key"), "jaccard-keys")
    wanted = left.join(key.select("id").distinct(), "id").select("id", "digest", "shared", F.col("doc_id").alias("d"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).select("id", "digest", "text", "shared")
    sets = written(texts.mapInPandas(_full_sets, "id long, keys binary").dropDuplicates(["id"]), "jaccard-sets")

    # documents connected by shared shingles are a family; a family of up to `family` documents is one group instead of
    # the many of its shingles, which hold the same documents again and again
    chained = components(key.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    sized = chained.join(key.select("id", "n").distinct(), "id").groupBy(F.col("comp").alias("key")).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    sized = sized.where(F.col("rows") <= family)
    member = chained.withColumnRenamed("comp", "key").join(sized, "key").join(key.select("id", "n").distinct(), "id")
    loose = key.join(member.select("id"), "id", "left_anti").select("key", "id", "n", "rows", "tokens")
    key = written(member.select("key", "id", "n", "rows", "tokens").unionByName(loose).withColumn("blocks", _blocks(rows, tokens)), "jaccard-groups")

    # first, each document's largest two groups; one too large for a task is cut at random, three times over
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rows"), "key"))
    chosen = key.select("key", place.alias("place")).where("place <= 2").select("key").distinct()
    near = key.join(chosen, "key").withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    near = written(near.withColumn("block", F.pmod(F.xxhash64("id", "key", "other"), "blocks")), "jaccard-near")
    links = written(_joined(near.select("key", "block", "other", "id", F.col("id").alias("comp")), sets), "jaccard-links")
    labels = components(links)

    # then every other group whose documents are not all connected, compared across components; a group within one that
    # was compared whole has nothing new
    whole = near.where("blocks = 1").select("id", F.col("key").alias("whole"))
    open_ = key.join(whole.select(F.col("whole").alias("key")).distinct(), "key", "left_anti")
    inside = open_.join(whole, "id").groupBy("key", "rows", "whole").agg(F.count("*").alias("n")).where("n = rows").select("key").distinct()
    known = open_.join(inside, "key", "left_anti").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    known = known.join(split, "key")
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    major = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most")).select("key", F.col("most.comp").alias("major"))
    known = known.join(major, "key").withColumn("minor", F.col("comp") != F.col("major"))
    apart = known.where("minor").groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).select("key", _blocks(rows, tokens).alias("others"))
    known = known.join(apart, "key")
    block, other = (F.pmod(F.xxhash64("id", "key", F.lit(x)), F.col(x)).cast("int") for x in ("blocks", "others"))
    every = F.struct(block.alias("block"), F.lit(0).alias("other"))
    across = F.when(F.col("others") > 1, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(block.alias("block"), i.alias("other")))).otherwise(F.array(every))
    down = F.when(F.col("minor") & (F.col("blocks") > 1), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), other.alias("other")))).otherwise(F.expr("array()"))
    group = known.select("key", "id", "comp", F.explode(F.array_distinct(F.concat(across, down))).alias("to")).select("key", "to.block", "to.other", "id", "comp")
    more = written(_joined(group, sets), "jaccard-links")
    labels = components(more, labels)

    classes = left.select("digest", "id").join(labels, "id").select("digest", F.col("comp"))
    named = units.where("bucket < 0").select("doc_id", "digest", "n", "key").join(classes, "digest", "left")
    named = named.withColumn("class", F.when(F.col("comp").isNotNull(), F.concat(F.lit("c"), F.col("comp").cast("string"))).otherwise(F.hex("digest")))
    named = written(named, "jaccard-named")  # plain tables on both sides: a hot class of the join can be split
    least = written(named.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "jaccard-least")
    out = named.join(least, "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), *([F.col("key").alias(name), "class"] if name else []))


def _joined(group: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found in each (key, block, other) of group (…, id, comp)."""
    rows = group.join(sets, "id")
    return rows.groupBy("key", "block", "other").applyInPandas(_group_links, "a long, b long")
