"""Tables and files written at the end of a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import records
from .operators import rules
from .session import scratch_path
from .sources import bibtex

# Sub-folder of each decision.
SUBSETS = {"include": "included_articles", "exclude": "excluded_articles", "uncertain": "uncertain_articles"}


def entry_projection(articles: DataFrame) -> DataFrame:
    """Flat table of entry key, type, filled fields and author names, with lists joined to text."""
    flat = records.flatten_lists(articles)
    lists = [c for c in ("authors", "keywords", "publication_type") if c in articles.columns]
    extra = [] if "extra" not in articles.columns else [F.to_json("extra").alias("extra")]
    skip = {*lists, "ord", "extra", "keywords_str", *[f"{c}_str" for c in lists]}
    return flat.select(
        F.col("entry_id").alias("entry_key"),
        *[c for c in articles.columns if c not in skip and c != "entry_id"],
        *[F.col(f"{c}_str").alias(c) for c in lists],
        *extra,
    )


def write_table(df: DataFrame, path: str, file_format: str = "csv", mode: str = "overwrite") -> None:
    """Write flat rows as csv (with header), json or parquet, one file per task."""
    if file_format not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {file_format!r}")
    options = {"header": True, "quote": '"', "escape": '"'} if file_format == "csv" else {}
    df.write.mode(mode).format(file_format).options(**options).save(path)


def write_decision_subsets(results: DataFrame, path: str, key: Column | str = "entry_id") -> None:
    """BibTeX files of the included, excluded and uncertain articles, one folder each.

    The screening behind ``results`` runs once: its entries go to the shared folder, and the subsets are copied from there.
    """
    spark, key = results.sparkSession, F.col(key) if isinstance(key, str) else key
    named = results.filter(F.col("decision").isin(*SUBSETS))
    entries = scratch_path(spark, "entries")
    named.select(bibtex.entry_text(named, key).alias("value"), "decision").write.partitionBy("decision").parquet(entries)
    stored = spark.read.schema("value string, decision string").parquet(entries)
    for decision, folder in SUBSETS.items():
        stored.filter(F.col("decision") == decision).select("value").write.mode("overwrite").text(f"{path}/{folder}")


def write_results(results: DataFrame, path: str, file_format: str = "csv") -> None:
    write_table(rules.result_projection(results), path, file_format)
