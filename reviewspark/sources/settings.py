"""Seed labels and the JSON settings: criteria, search strategy, per-source options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

OPTION_TYPES = {
    "enabled": "boolean", "max_results": "int", "fields": "array<string>", "languages": "array<string>",
    "article_types": "array<string>", "species": "array<string>", "subject_areas": "array<string>",
    "document_types": "array<string>", "evidence_types": "array<string>",
    "date_range": "struct<start:string,end:string>",
}
_OPTIONS = "struct<" + ",".join(f"{k}:{v}" for k, v in OPTION_TYPES.items()) + ">"


def _json(spark: SparkSession) -> DataFrameReader:
    """Settings files: one object over several lines; a file that is not JSON is an error, not an empty table."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST")


def _whole_label(label: Column) -> Column:
    number = label.try_cast("int")
    wrong = F.concat(F.lit("a seed label is not a whole number: "), F.coalesce(label, F.lit("(blank)")))
    return F.when(number.isNull(), F.raise_error(wrong).cast("int")).otherwise(number)


def scan_seed_labels(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, label, reason of a CSV file with a header; the last row of a repeated id counts.

    Quoted values may hold line breaks; a row without a whole-number label is an error.
    """
    quoted = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    raw = spark.read.options(**quoted).csv(path)
    missing = {"entry_id", "label"} - set(raw.columns)
    if missing:
        raise ValueError(f"seed labels lack the columns {sorted(missing)}")
    reason = F.col("reason") if "reason" in raw.columns else F.lit("")
    placed = raw.select(
        "entry_id",
        _whole_label(F.col("label")).alias("label"),
        F.coalesce(reason, F.lit("")).alias("reason"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("ord"),
    )
    last = F.max_by(F.struct("label", "reason"), "ord").alias("last")
    return placed.groupBy("entry_id").agg(last).select("entry_id", "last.*")


def scan_criteria(spark: SparkSession, path: str) -> DataFrame:
    """(stage, kind, ordinal, phrase) rows of the screening section, phrases in their order."""
    stages = "map<string,struct<inclusion_criteria:array<string>,exclusion_criteria:array<string>>>"
    rows = _json(spark).schema(f"screening {stages}").json(path)
    rows = rows.select(F.explode("screening").alias("stage", "lists"))

    def kind(name: str) -> DataFrame:
        phrases = F.posexplode(F.col(f"lists.{name}_criteria")).alias("ordinal", "phrase")
        return rows.select("stage", F.lit(name).alias("kind"), phrases)

    return kind("inclusion").unionByName(kind("exclusion"))


def criteria_phrases(criteria: DataFrame, kind: str, stage: str = "title_abstract") -> list[str]:
    """The phrases of one stage and kind in order (a handful of settings, read to the driver)."""
    rows = criteria.filter((F.col("stage") == stage) & (F.col("kind") == kind)).orderBy("ordinal").collect()
    return [r["phrase"] for r in rows]


def scan_strategy(spark: SparkSession, path: str) -> DataFrame:
    """(category, ordinal, term, within, between) rows of the search terms."""
    schema = (
        "search_strategy struct<search_terms:map<string,array<string>>,"
        "boolean_operators:struct<within_category:string,between_categories:string>>"
    )
    rows = _json(spark).schema(schema).json(path).select("search_strategy.*")
    operators = [F.col(f"boolean_operators.{c}").alias(a) for c, a in
                 (("within_category", "within"), ("between_categories", "between"))]
    exploded = rows.select(F.explode("search_terms").alias("category", "terms"), *operators)
    return exploded.select("category", F.posexplode("terms").alias("ordinal", "term"), "within", "between")


def scan_source_options(spark: SparkSession, path: str, sources: list[str]) -> DataFrame:
    """One row per source with its options; what a source leaves open comes from the defaults."""
    schema = f"database_defaults {_OPTIONS}, databases map<string,{_OPTIONS}>"
    rows = _json(spark).schema(schema).json(path)
    rows = rows.select("*", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))

    def option(name: str) -> Column:
        own = F.col("databases")[F.col("source")][name]
        value = F.coalesce(own, F.col(f"database_defaults.{name}"))
        return (F.coalesce(value, F.lit(True)) if name == "enabled" else value).alias(name)

    return rows.select("source", *[option(n) for n in OPTION_TYPES])
