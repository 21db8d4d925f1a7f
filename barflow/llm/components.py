"""Connected components by alternating large and small stars, in joins and aggregations only.

A node of any degree is safe: the smallest neighbour is an aggregate with map-side
combine, and the join that hands it back is a sort-merge join whose large keys adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u's least neighbour or itself, handed to its neighbours v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def components(edges: DataFrame) -> DataFrame:
    """Stored table (node, component) for every node of ``edges`` (src, dst), both long; a component is named by its least node.

    Self loops and repeated edges are ignored, rows with a null end are dropped, and no
    edges give no rows. The number of rounds is logarithmic in the longest path.
    """
    clean = (
        edges.filter("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    now = cut(clean)
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        large = _star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        after = cut(small.filter("a <> b").distinct())
        state = after.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("bit_xor(xxhash64(b, a, 7))").alias("y")
        ).first()
        discard(now)
        now = after
        if state == mark:
            break
        mark = state
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = cut(named.union(roots))
    discard(now)
    return found
