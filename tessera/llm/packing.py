"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import default_tokenizer, encoder, small_batches, trim


class Tournament:
    """Capacities of bins as a winner tree: the first bin with room for a size is found in log2(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Takes size from the first bin that has room; its number, or -1."""
        best, k = self.best, 1
        if best[1] < size:
            return -1
        while k < self.width:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        found, k = k - self.width, k // 2
        while k:
            best[k] = max(best[2 * k], best[2 * k + 1])
            k //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; sizes must be from 1 to capacity. Ties keep the items' order."""
    tree, bins = Tournament(max(1, len(sizes)), capacity), []
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.place(sizes[k])
        while b >= len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def pack_group(lengths: list[int], capacity: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every token of a group's documents once.

    Full sequences of a long document come first; the rests go through first-fit decreasing. Then the emptiest bins
    are emptied into gaps of at least `least` tokens, cutting documents, and the last bin left part full is cut into
    sequences whose lengths are powers of two, which need no padding.
    """
    pieces, rests, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for at in range(0, n - capacity + 1, capacity):
            pieces.append((doc, at, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((doc, n - n % capacity, n % capacity))
    bins = [[rests[k] for k in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    bins.sort(key=lambda b: -sum(r[2] for r in b))
    room = [capacity - sum(r[2] for r in b) for b in bins]
    first, last = 0, len(bins) - 1
    while first < last:
        if room[first] < least:
            first += 1
            continue
        doc, at, n = bins[last].pop()
        cut = min(n, room[first])
        if 0 < n - cut < least and cut > 2 * least:  # leaves no crumb
            cut -= least
        bins[first].append((doc, at, cut))
        room[first] -= cut
        if cut < n:
            bins[last].append((doc, at + cut, n - cut))
            if room[first]:
                first += 1
        elif not bins[last]:
            last -= 1
    for k, b in enumerate(bins[: last + 1]):
        total, offset, left = sum(r[2] for r in b), 0, 0
        size = capacity if total + least > capacity or k < last else 0
        for doc, at, n in b:
            while n:
                if size != capacity and not left:
                    left = 1 << (total.bit_length() - 1)
                    total -= left
                step = n if size == capacity else min(n, left)
                pieces.append((doc, at, step, sequence, offset))
                doc, at, n, offset = doc, at + step, n - step, offset + step
                if size != capacity:
                    left -= step
                    if not left:
                        sequence, offset = sequence + 1, 0
        if size == capacity:
            sequence += 1
    return pieces


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, group_docs: int = 1024, least: int = 32, seed: int = 17, keep_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens; a row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]. Documents are dealt by a hash
    to about count / group_docs groups and each group is packed alone, so a lost executor costs its groups only and a
    group's memory is bounded by the ids of its documents. Full sequences of long documents travel as checksums; only
    the rests travel as ids unless keep_ids. Null texts are empty: they hold end_id alone. Repeated rows are packed
    each, and dealt to different groups by their place in the table; an empty table gives no rows. Reruns over the same
    files agree.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.uint32(end_id).tobytes()
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))

    def tokens(batches):
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for text in b["text"]:
                ids = enc.encode(text) + end
                n = len(ids) // 4
                full = n - n % capacity
                crcs = [zlib.crc32(ids[4 * k : 4 * (k + capacity)]) for k in range(0, full, capacity)]
                out.append((n, crcs, ids if keep_ids else ids[4 * full :]))
            yield pd.concat([b[["doc_id", "grp"]], pd.DataFrame(out, columns=["n", "crcs", "ids"], index=b.index)], axis=1)
        trim()

    def packed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "n", "ids"], kind="stable", ignore_index=True)
        lengths, crcs, ids = b["n"].tolist(), b["crcs"].tolist(), b["ids"].tolist()
        rows = []
        for doc, start, length, sequence, offset in pack_group(lengths, capacity, least):
            skip = 0 if keep_ids else lengths[doc] - lengths[doc] % capacity
            if start >= skip:
                part = ids[doc][4 * (start - skip) : 4 * (start - skip + length)]
                crc = zlib.crc32(part)
            else:
                part, crc = b"", crcs[doc][start // capacity]
            rows.append((doc, start, length, crc, lengths[doc], (int(key[0]) << 32) + sequence, offset, part))
        out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        out.insert(0, "doc_id", b["doc_id"].take(out.pop("doc")).array)
        return out if keep_ids else out.drop(columns="ids")

    rows = docs.select("doc_id", "text").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)))
    rows = rows.mapInPandas(tokens, "doc_id long, grp long, n long, crcs array<long>, ids binary")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.groupBy("grp").applyInPandas(packed, schema + ", ids binary" * keep_ids)
