"""Connected components of a graph of any size: alternating large-star and small-star rounds (union-find by stars).

Every round is two aggregations by key with partial sums and two joins, its edges written to the shared folder; nothing but a
count and a checksum comes to the driver, observed while the edges are written. The number of rounds grows with the logarithm
of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from unitflow.llm.common import drop_written, small_or_not, written


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (u, v) as a written table, with their count and checksum."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long; any order, repeated, loops allowed, nulls ignored) to (id, label) of every id in an edge that
    isn't its component's smallest; label is that smallest id. No edges: no rows. The table is a written one."""
    current, state = _kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, last = state, current
        current, state = _kept(small)
        drop_written(last)
        if before == state:
            break
    return current.withColumnsRenamed({"u": "id", "v": "label"})


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of the graph that has these edges (a, b) too. Only what the edges tie together is worked out: the graph of the
    components so far. Both tables are written ones; labels are given up for the result."""
    of = lambda name, to: labels.withColumnsRenamed({"id": name, "label": to})
    ties = edges.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    more = components(ties)
    if more.isEmpty():
        drop_written(more)
        return labels
    moved = labels.join(small_or_not(more.select(F.col("id").alias("label"), F.col("label").alias("to")), 16), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    after = written(moved.unionByName(more), "labels")
    drop_written(labels)
    drop_written(more)
    return after
