"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations (a minimum per node, combined map-side) and
joins back to the edges, so a hub's neighbours never meet in one task; a hot
hub is an ordinary skewed equi-join, which adaptive execution splits.  Each
round is cut from its lineage by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each node of ``edges``; component is its least node.

    Edges with a null end and loops are dropped; repeated edges count once; no
    edges give an empty table.  Nodes may be of any type that has an order.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: equal for equal sets."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first()
    return tuple(row)
