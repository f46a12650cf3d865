"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

MAX_STEPS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node with an edge and the smallest node it reaches. Ids are bigint; self-loops are allowed.

    Each step points nodes at smaller neighbours; paths shrink by a constant factor, so the number of steps grows with
    the logarithm of the longest path. A node with many neighbours only takes a minimum, combined before the shuffle.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = checkpoint(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    seen = None
    for _ in range(MAX_STEPS):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        small = large.join(low, "u").select(F.explode(ends).alias("x"))
        e = checkpoint(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    found = nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left")
    return found.select("node", F.coalesce("v", "node").alias("component"))
