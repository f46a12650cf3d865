"""Row numbers and running totals over whole tables without one task seeing them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH_DIGITS = 3  # 16**3 slices per group
SCORE_SLICES = 256


def shuffle_hash(entry_id: Column | str, seed: int) -> Column:
    """A seeded pseudo-random order that is the same in every engine and partitioning."""
    return F.md5(F.concat_ws("|", entry_id, F.lit(str(seed))))


def ranked_by_hash(df: DataFrame, by: Sequence[str], entry_id: str, seed: int, name: str = "rank") -> DataFrame:
    """Exact row number of each row within ``by`` in seeded hash order.

    The hash is cut into equal slices: rows are numbered inside a slice and the sizes of the slices before it are
    added, so a group of any size is spread over 4096 tasks.
    """
    hashed = df.withColumn("_hash", shuffle_hash(entry_id, seed)).withColumn(
        "_slice", F.substring("_hash", 1, HASH_DIGITS)
    )
    keys = [*by, "_slice"]
    sizes = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("_hash", entry_id)
    numbered = hashed.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_hash", "_slice", "_inside", "_start")
    )


def row_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """0-based position of each row in the order of ``order``, which must identify rows.

    Range partitioning puts the rows in order across tasks; numbers inside a task start at the sizes of the tasks
    before it. The task number is written down with the rows, so a lost executor cannot change it.
    """
    from ..session import checkpoint

    placed = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    placed = checkpoint(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per task of the range partitioning
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.join(starts, "_part")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_part", "_start")
    )


def score_slice(df: DataFrame, score: str) -> Column:
    """Number of a value range of ``score``, from quantiles, so that ranges hold similar numbers of rows."""
    shares = [i / SCORE_SLICES for i in range(1, SCORE_SLICES)]
    bounds = df.agg(F.percentile_approx(score, shares).alias("b")).collect()[0]["b"] or []
    edges = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(edges, lambda e: e <= F.col(score)))
