"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

def hot_keys(sizes: DataFrame, key: str, size: str, rows_per_task: int) -> DataFrame:
    """All keys above ``rows_per_task`` rows with the number of salts each needs."""
    return (
        sizes.filter(F.col(size) > rows_per_task)
        .select(
            F.xxhash64(key).alias("_hot"),
            F.ceil(F.col(size) / rows_per_task).cast("int").alias("_salts"),
        )
        .groupBy("_hot")
        .agg(F.max("_salts").alias("_salts"))
    )


def crowded(sizes: DataFrame, key: str, size: str, rows_per_task: int) -> DataFrame | None:
    """``hot_keys`` worked out now, or None when there are none and the join can be an ordinary one."""
    hot = checkpoint(hot_keys(sizes, key, size, rows_per_task))
    return None if hot.isEmpty() else hot


def _with_salts(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return df.withColumn("_salts", F.lit(1))
    # the list has one row per hot key; the optimizer broadcasts it only where it is small enough
    marked = df.withColumn("_hot", F.xxhash64(key)).join(hot, "_hot", "left")
    return marked.withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_hot")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: DataFrame | None,
    spread_by: Column,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Equi-join on ``key``; rows of a hot key on the left are spread over salts and met by copies of the right.

    Cold keys have one salt, so for them this is the ordinary shuffle join; ``hot`` None means all keys are known
    to be cold. ``spread_by`` must vary within a
    key of the left side. Both sides may have no other column name in common when ``condition`` is given.
    """
    spread = (
        _with_salts(left, key, hot)
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_salts").cast("long")).cast("int"))
        .drop("_salts")
    )
    copied = (
        _with_salts(right, key, hot)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts")
    )
    if condition is None:
        return spread.join(copied, [key, "_salt"], how).drop("_salt")
    other = copied.withColumnRenamed(key, "_rkey").withColumnRenamed("_salt", "_rsalt")
    on = (F.col(key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")) & condition
    return spread.join(other, on, how).drop("_salt", "_rkey", "_rsalt")


def crowded_pairs(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int, rows_per_task: int) -> DataFrame | None:
    """Keys whose rows of both sides make more pairs than a task should compare, with the salts of each side."""
    counts = left.groupBy(key).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("m"))
    if right is left:
        counts = counts.withColumn("m", F.col("n"))
    else:
        others = right.groupBy(key).agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("m"))
        counts = counts.unionByName(others).groupBy(key).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    parts = lambda n: F.ceil(F.col(n) / rows_per_task).cast("int")
    hot = checkpoint(counts.where(F.col("n") * F.col("m") > pairs_per_task).select(key, parts("n").alias("_rows"), parts("m").alias("_columns")))
    return None if hot.isEmpty() else hot


def grid_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, left_by: Column, right_by: Column, condition: Column) -> DataFrame:
    """Inner join on ``key`` of two sides with no other column name in common (``right`` calls it r_``key``).

    The pairs of a hot key are cut into a grid: a row of either side is in one line of it and goes to every cell of that.
    """
    if hot is None:
        return left.join(right, (F.col(key) == F.col(f"r_{key}")) & condition)

    def dealt(df: DataFrame, name: str, own: str, other: str, by: Column, line: str, cross: str) -> DataFrame:
        marked = df.join(hot.withColumnRenamed(key, name), name, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        marked = marked.withColumn(line, F.pmod(F.xxhash64(by), F.col(own).cast("bigint")).cast("int"))
        return marked.withColumn(cross, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    a = dealt(left, key, "_rows", "_columns", left_by, "_i", "_j")
    b = dealt(right, f"r_{key}", "_columns", "_rows", right_by, "_rj", "_ri")
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")) & condition
    return a.join(b, on).drop("_i", "_j", "_ri", "_rj")
