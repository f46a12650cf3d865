"""Collect stage: filter and cap each source, then one keyed table of all articles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as tx
from ..operators import filters, ranking

# Fields of the combined export, in order.
COMBINED_FIELDS = ["title", "journal", "year", "volume", "issue", "pages", "abstract", "doi", "url"]
COMBINED_IDS = ["pmid", "scopus_id", "embase_id", "eid"]


@dataclass
class Search:
    """What to keep of the scanned articles. Empty settings are no condition.

    ``options``: the options of each source as a table (`settings.scan_source_options`): on or off, date range, lists of
    wanted values, the fields that search terms are looked for in, and the cap. They apply besides the common settings.
    """

    strategy: Mapping[str, Sequence[str]] = field(default_factory=dict)
    date_range: tuple[str, str] | None = None
    facets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    enabled: Mapping[str, bool] = field(default_factory=dict)
    max_results: int | None = None
    within: str = "OR"
    between: str = "AND"
    options: DataFrame | None = None


def search(articles: DataFrame, wanted: Search) -> DataFrame:
    out, fields = filters.enabled_source_filter(articles, wanted.enabled), None
    if wanted.options is not None:
        out = filters.option_filter(filters.with_options(out, wanted.options))
        fields = F.col("options")["fields"]
    out = filters.strategy_filter(out, wanted.strategy, within=wanted.within, between=wanted.between, fields=fields)
    if wanted.date_range:
        out = filters.date_range_filter(out, *wanted.date_range)
    out = filters.facet_filter(out, wanted.facets)
    if wanted.options is not None:
        out = filters.limit_results(out.drop("options"), wanted.options)
    return out if wanted.max_results is None else filters.limit_results(out, wanted.max_results)


def combined_keys(articles: DataFrame) -> DataFrame:
    """Add ``entry_key``: first author, year and 0-based position in the combined order.

    Positions are worked out on ids only; the articles are moved once, by the join.
    """
    places = ranking.row_index(articles.select("entry_id", "ord"), "ord")
    numbered = articles.join(places, ["entry_id", "ord"])
    key = records.author_year_key("authors", "year", F.col("index").cast("string"))
    return numbered.withColumn("entry_key", key).drop("index")


def combine_sources(sources: Sequence[DataFrame], wanted: Search) -> DataFrame:
    """All sources filtered, capped and united, with the fields of the combined export."""
    found = search(filters.union_sources(*sources), wanted)
    keyed = combined_keys(found)
    present = [c for c in [*COMBINED_FIELDS, *COMBINED_IDS] if c in keyed.columns]
    return keyed.select(
        "entry_key",
        "source",
        records.format_authors("authors").alias("author"),
        *[tx.text(c).alias(c) for c in present],
        tx.text("keywords").alias("keywords"),
    )
