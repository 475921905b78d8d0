"""Connected components of links, on the executors: labels and links stay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def components(links: DataFrame, labels: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(id, comp) of every id in links (a, b): comp is the smallest id reachable. labels (id, comp) are where to start.

    Each round joins neighbouring components to the smallest of them and follows the paths to their ends; the links between different
    components shrink from round to round, and the work ends when there are none. Links left after the last round are an error.
    Tables of finished rounds are deleted.
    """
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if labels is None:
        labels = ids.withColumn("comp", F.col("id"))
    else:
        fresh = ids.join(labels, "id", "left_anti").withColumn("comp", F.col("id"))
        labels = labels.unionByName(fresh)
    labels = written(labels, "components")
    edges, last = links.select("a", "b"), None
    for _ in range(rounds):
        a, b = (labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        edges = written(edges, "component-links")
        if last is not None:
            discard(last)
        last = edges
        if edges.isEmpty():
            discard(edges)
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        flat = hook = written(hook, "component-hooks")
        while True:  # a hook's target may itself be hooked: labels must be ids that no hook moves
            for _ in range(3):
                hook = _jump(hook).select("id", F.coalesce("top", "up").alias("up"))
            before, hook = flat, written(hook, "component-hooks")
            flat = hook
            discard(before)
            if _jump(hook).where("top <> up").isEmpty():
                break
        old = labels
        labels = labels.join(hook.select(F.col("id").alias("comp"), "up"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        labels = written(labels, "components")
        discard(old)
        discard(flat)
    else:
        raise RuntimeError(f"links between components are left after {rounds} rounds")
    return labels


def _jump(hook: DataFrame) -> DataFrame:
    """Hooks (id, up) with the hook of their target, top."""
    return hook.join(hook.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left")
