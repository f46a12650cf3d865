"""Small helpers of the operators in this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared directory and read it back: durable, columnar, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *columns: Column, text_col: str = "text") -> DataFrame:
    """``columns``, the text and all other given columns as one struct `row`: no name of theirs meets one of an operator."""
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"), *columns)


def unpacked(rows: DataFrame, names: Sequence[str], text_col: str = "text", **changed: Column) -> DataFrame:
    """The columns ``names`` again, in their order; ``changed`` has other values of some."""
    changed = {text_col: F.col("text")} | changed
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Adds pos, the place of a row in its group's order from 0, and group_rows. ``by`` holds no nulls; no task holds a group.

    One range exchange over (by, order) puts the rows in order across tasks; the rows of a task are numbered as they lie, and
    what the tasks before hold of the group is added. The numbers are written down with the rows.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = saved(dealt.withColumn("_line", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("_task", F.shiftright("_line", 33))  # a line number is the task's number and the place in it
    runs = dealt.groupBy(*by, "_task").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*by, "_task", "_first", before.alias("_before"), F.sum("_n").over(group).alias("group_rows"))
    met = dealt.join(runs, [*by, "_task"])
    return met.withColumn("pos", F.col("_before") + F.col("_line") - F.col("_first")).drop("_task", "_line", "_first", "_before")
