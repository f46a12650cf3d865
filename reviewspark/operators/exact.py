"""Exact duplicate passes: same identifier, then same title and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import checkpoint
from . import skew

# Confidence and reason of the two exact passes, and the status of a sure duplicate.
DOI_CONFIDENCE, DOI_REASON = 1.0, "DOI match"
TITLE_CONFIDENCE, TITLE_REASON = 0.9, "Title and year match"
CONFIRMED = "Confirmed Duplicate"

ROWS_PER_TASK = 1_000_000


def comparison_columns(articles: DataFrame) -> DataFrame:
    """The narrow, normalised columns every duplicate pass works on."""
    return articles.select(
        "entry_id",
        "ord",
        tx.normalize_doi("doi").alias("doi_n"),
        tx.normalize_title("title").alias("title_n"),
        tx.text("year").alias("year"),
        tx.author_key("author").alias("author_n"),
    )


def doi_key() -> Column:
    return F.when(F.col("doi_n") != "", F.concat(F.lit("doi:"), "doi_n"))


def title_key() -> Column:
    """Only articles without a DOI, with both title and year, take part in the second pass."""
    known = (F.col("doi_n") == "") & (F.col("title_n") != "") & (F.col("year") != "")
    return F.when(known, F.concat(F.lit("title:"), "title_n", F.lit("\x1f"), "year"))


def first_of_groups(keyed: DataFrame) -> DataFrame:
    """One row per key: its first article (the survivor) and the group size. Combines map-side."""
    first = F.min(F.struct("ord", "entry_id", "title_n", "author_n", "year")).alias("first")
    return keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(first, F.count(F.lit(1)).alias("n"))


def group_pairs(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every later member of a group as a duplicate of the first one; a huge group is spread over tasks."""
    repeated = groups.filter(F.col("n") > 1)
    hot = skew.crowded(repeated, "key", "n", ROWS_PER_TASK)
    members = keyed.filter(F.col("key").isNotNull()).select("entry_id", "key")
    survivors = repeated.select("key", F.col("first.entry_id").alias("primary_id"))
    by_doi = F.col("key").startswith("doi:")
    return (
        skew.salted_join(members, survivors, "key", hot, F.col("entry_id"))
        .filter(F.col("entry_id") != F.col("primary_id"))
        .select(
            "primary_id",
            F.col("entry_id").alias("dup_id"),
            F.when(by_doi, F.lit(DOI_CONFIDENCE)).otherwise(F.lit(TITLE_CONFIDENCE)).alias("confidence"),
            F.when(by_doi, F.lit(DOI_REASON)).otherwise(F.lit(TITLE_REASON)).alias("reason"),
            F.lit(CONFIRMED).alias("status"),
        )
    )


def _one_pass(articles: DataFrame, key: Column) -> DataFrame:
    keyed = comparison_columns(articles).withColumn("key", key)
    return group_pairs(keyed, checkpoint(first_of_groups(keyed)))


def dedup_doi(articles: DataFrame) -> DataFrame:
    return _one_pass(articles, doi_key())


def dedup_title_year(articles: DataFrame) -> DataFrame:
    return _one_pass(articles, title_key())


def last_value_wins(articles: DataFrame) -> DataFrame:
    """Collapse repeated entry ids: the later record's values at the first record's position."""
    fields = [c for c in articles.columns if c not in ("entry_id", "ord")]
    kept = F.max_by(F.struct(*fields), "ord").alias("kept")
    grouped = articles.groupBy("entry_id").agg(F.min("ord").alias("ord"), kept)
    return grouped.select("entry_id", "ord", "kept.*").select(*articles.columns)
