"""All duplicate passes together, and the tables reported from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import exact, similar, skew


@dataclass
class Deduplicated:
    unique: DataFrame
    """Articles left after removing confirmed duplicates (borderline ones stay), one per entry id."""
    pairs: DataFrame
    """primary_id, dup_id, confidence, reason, status."""


def exact_passes(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of both exact passes, their survivors, and the titled articles neither pass looked at.

    The passes never compete for an article (the second takes articles without a DOI only), so one key column
    and one shuffle serve both. The articles are read once; what is compared is written down.
    """
    base = exact.comparison_columns(articles)
    keyed = checkpoint(base.withColumn("key", F.coalesce(exact.doi_key(), exact.title_key())))
    groups = checkpoint(exact.first_of_groups(keyed))
    pairs = exact.group_pairs(keyed, groups)
    kept = groups.select("first.*", F.when(F.col("key").startswith("doi:"), 1).otherwise(2).alias("pass"))
    leftovers = keyed.filter(F.col("key").isNull() & (F.col("title_n") != "")).drop("key")
    return pairs, kept, leftovers


def duplicate_pairs(articles: DataFrame) -> DataFrame:
    """Pairs of all passes; a repeated entry id is one article from the start, with its last values."""
    narrow = exact.last_value_wins(articles.select("entry_id", "ord", "title", "author", "year", "doi"))
    pairs, kept, leftovers = exact_passes(narrow)
    return pairs.unionByName(similar.near_duplicates(leftovers, kept))


def unique_articles(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    removed = pairs.filter(F.col("status") == exact.CONFIRMED).select(F.col("dup_id").alias("entry_id"))
    return exact.last_value_wins(articles).join(removed, "entry_id", "left_anti")


def deduplicate(articles: DataFrame) -> Deduplicated:
    pairs = checkpoint(duplicate_pairs(articles))
    return Deduplicated(unique_articles(articles, pairs), pairs)


def duplicate_report(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of every pair with source, title, authors and year."""
    articles = exact.last_value_wins(articles.select("entry_id", "ord", "source", "title", "author", "year"))
    named = pairs.select(F.explode(F.array("primary_id", "dup_id")).alias("entry_id")).distinct()
    articles = checkpoint(articles.join(named, "entry_id", "left_semi"))
    sizes = pairs.groupBy("primary_id").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.crowded(sizes, "primary_id", "n", exact.ROWS_PER_TASK)

    def side(name: str) -> DataFrame:
        return articles.select(
            F.col("entry_id").alias("primary_id" if name == "primary" else "dup_id"),
            F.col("source").alias(f"{name}_source"),
            F.col("title").alias(f"{name}_title"),
            F.col("author").alias(f"{name}_authors"),
            F.col("year").alias(f"{name}_year"),
        )

    both = skew.salted_join(pairs, side("primary"), "primary_id", hot, F.col("dup_id"))
    return both.join(side("duplicate"), "dup_id").select(
        *[f"{name}_{c}" for name in ("primary", "duplicate") for c in ("source", "title", "authors", "year")],
        "confidence",
        "reason",
        "status",
    )


def flow_counts(n_articles: DataFrame, pairs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Stage counts of a review flow diagram as (stage, n) rows; zeros are kept.

    Every record counts as identified; of records that share an entry id one goes on.
    """
    total = n_articles.agg(F.count(F.lit(1)).alias("identified"), F.count_distinct("entry_id").alias("ids"))
    found = pairs.agg(
        F.count_if(F.col("status") == exact.CONFIRMED).alias("duplicates_removed"),
        F.count_if(F.col("status") == similar.REVIEW).alias("borderline"),
    )
    stages = (
        total.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one")
        .withColumn("unique", F.col("ids") - F.col("duplicates_removed"))
    )
    names = ["identified", "duplicates_removed", "borderline", "unique"]
    if decisions is not None:
        kinds = {"included": "include", "excluded": "exclude", "uncertain": "uncertain"}
        seen = decisions.agg(
            F.count(F.lit(1)).alias("screened"),
            *[F.count_if(F.col("decision") == value).alias(name) for name, value in kinds.items()],
        )
        stages = stages.join(seen.withColumn("one", F.lit(1)), "one")
        names += ["screened", *kinds]
    rows = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in names])
    return stages.select(F.inline(rows))
