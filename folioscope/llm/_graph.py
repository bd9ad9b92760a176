"""Connected components of large graphs, by alternating stars.

Each round joins edges with the least neighbour of their ends; no vertex's
neighbours are gathered, so hubs of any degree are only a skewed join, which
adaptive execution splits.  Rounds are written out, so that a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b longs): comp is the least node that it is linked with."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = _store.pin(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Each larger neighbour moves to the least one of the neighbourhood ...
        large = both.filter("b > a").join(_store.merged(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = _store.pin(large, "large-star")
        # ... then smaller neighbours, and the node itself, move to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(_store.merged(small), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = _store.pin(moved.select("e.a", "e.b").filter("a <> b").distinct(), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
