"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions alone.

A text's words are runs of other than white space, cut after 16 characters, so scripts without spaces have words too.
A shingle is five words in a row; four marks stand before the first word, so a text of n words has n shingles and
short texts compare as well. A sketch is the k smallest distinct 64-bit shingle hashes, ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]{1,16}"
SHINGLE = 5


def sketch(text: Column, k: int = 128) -> Column:
    """Bottom-k sketch of a text as array<long>; null and empty texts, and white space alone, have the empty sketch."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    marked = F.concat(F.array_repeat(F.lit(0).cast("long"), SHINGLE - 1), words)
    # array(x) and transform bind x once; named directly, it would be evaluated for every element
    shingles = F.transform(F.array(marked), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])))
    kept = F.transform(shingles, lambda s: F.slice(F.sort_array(F.array_distinct(s)), 1, k))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.get(kept, F.lit(0))).otherwise(F.array().cast("array<long>"))


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of two parts together: sketches of parts merge to the sketch of the whole."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = 128) -> DataFrame:
    """Merges the sketches of each group: hashes are ranked, never gathered, so a group may have any size.

    Partial ranks within `sub` salted parts of a group bound what meets in one task to sub * k hashes.
    """
    flat = sketches.select(*keys, F.explode(column).alias("_h")).distinct().withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(64)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_h")
    top = flat.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    whole = Window.partitionBy(*keys).orderBy("_h")
    top = top.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _both(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    union = merge(a, b, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))), F.size(union)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sketches."""
    both, union = _both(a, b, k)
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below k, then (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b has: resemblance * |union| / |a|, at most 1; 1 where a is empty."""
    inside = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside))


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, found among groups of bounds and then within one group."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    if not groups:
        return F.lit(0)
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    outer = F.size(F.filter(firsts, lambda b: b <= F.col("doc_id")))
    inner = F.size(F.filter(F.get(table, outer - 1), lambda b: b <= F.col("doc_id")))
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * wide + inner)


def with_next(docs: DataFrame, bucket_docs: int = 256, max_buckets: int = 16_384) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the row that follows in descending doc_id; the last row's next
    is the first. Null doc_ids come last; rows with equal doc_id follow by a hash of their text.

    Rows are dealt to buckets of neighbouring ids at quantiles of doc_id, and the first row of each bucket also goes
    to the bucket before as a guest, so no task sees more than a bucket and the text moves once.
    """
    count = docs.count()
    buckets = max(1, min(max_buckets, count // bucket_docs))
    bounds: list[int] = []
    if buckets > 1:
        at = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 10 * buckets)).first()[0] or []))
    bucket = F.coalesce(_bucket(bounds), F.lit(-1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = {r.bucket: r.top for r in first.collect()}  # at most max_buckets + 1 rows
    held = sorted(tops, reverse=True)
    guests = [(b, tops[b], held[k - 1]) for k, b in enumerate(held)]
    heads = docs.sparkSession.createDataFrame(guests, "bucket int, top long, before int")
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(heads), "bucket", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    to = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.bucket", "to.guest", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_text", F.coalesce("next_text", "text"))


def fingerprints(docs: DataFrame, k: int = 128) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness; see the module for shingles.

    The edited text has its last floor(n / 3) code points replaced by the first as many, or all, of the next
    document's (descending doc_id; after the last, the first). Null texts are empty; an empty text's sketch is empty and
    resembles another empty one fully. A single row is its own next. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated), in_edited (estimated containment).
    """
    rows = with_next(docs)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("own", sketch(F.col("text"), k))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.select("doc_id", "n_chars", "bucket", "guest", "tie", "own", F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.when(F.col("guest") == 0, sketch(F.col("edited"), k)).alias("other"))
    rows = rows.withColumn("after", F.coalesce(F.lead("own").over(order), "own")).where("guest = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("after"), k).alias("near_next"), distinct_shingles(F.col("own"), k).alias("n_shingles"), containment(F.col("own"), F.col("other"), k).alias("in_edited"))
