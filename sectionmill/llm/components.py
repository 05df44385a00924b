"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialise


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Join each node's neighbours to the least of them; the minima are written first so
    that the join has two plain shuffles and a hub's rows can be split at run time."""
    least = materialise(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    joined = pairs.join(least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = materialise(out.where("u <> v").distinct(), "edges")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) gives (node, component): the least id that each node reaches.

    Self-loops and repeated edges are harmless; nodes without an edge don't appear. The
    edges stay in the shared folder between rounds; only their count and a checksum
    come to the driver.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True)
        small = _star(large, larger_only=False)
        drop(now)
        drop(large)
        now = small
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == seen:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
