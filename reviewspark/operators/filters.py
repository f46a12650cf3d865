"""Search strategy, filters, caps and look-ups over an article table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import checkpoint

# Identifier kinds that can be looked up, and the category matched against the article type.
ID_COLUMNS = {
    "embase": "embase_id",
    "pubmed_id": "pubmed_id",
    "doi": "doi",
    "pii": "pii",
    "lui": "lui",
    "medline": "medline",
}
TYPE_CATEGORY = "study_design"

def _join(parts: Sequence[Column], operator: str) -> Column:
    if operator.upper() not in ("AND", "OR"):
        raise ValueError(f"unknown operator {operator!r}")
    combine = Column.__and__ if operator.upper() == "AND" else Column.__or__
    return reduce(combine, parts)


def strategy_match(
    strategy: Mapping[str, Sequence[str]],
    type_col: Column,
    text_cols: Sequence[str] = ("title", "abstract", "keywords"),
    within: str = "OR",
    between: str = "AND",
    fields: Column | None = None,
) -> Column:
    """True where the text satisfies the search terms; an empty category is no condition.

    ``fields``: the names of the text columns that count for a row; null stands for all of them.
    """
    if within.upper() not in ("AND", "OR"):
        raise ValueError(f"unknown operator {within!r}")
    counts = lambda c: F.lit(True) if fields is None else F.coalesce(F.array_contains(fields, c), F.lit(True))
    body = F.lower(F.concat_ws("\n", *[F.when(counts(c), tx.text(c)) for c in text_cols]))
    groups = []
    for category, terms in strategy.items():
        if terms:
            where = F.lower(type_col) if category == TYPE_CATEGORY else body
            quoted = [re.escape(t.lower()) for t in terms]
            # one pass over the text per category: any term, or all of them wherever they stand
            pattern = "|".join(quoted) if within.upper() == "OR" else "(?s)^" + "".join(f"(?=.*(?:{q}))" for q in quoted)
            groups.append(where.rlike(pattern))
    return _join(groups, between) if groups else F.lit(True)


def strategy_filter(
    articles: DataFrame,
    strategy: Mapping[str, Sequence[str]],
    type_col: str = "entry_type",
    text_cols: Sequence[str] = ("title", "abstract", "keywords"),
    within: str = "OR",
    between: str = "AND",
    fields: Column | None = None,
) -> DataFrame:
    return articles.filter(strategy_match(strategy, tx.text(type_col), text_cols, within, between, fields))


def date_range_filter(articles: DataFrame, start: str, end: str, col: str = "year") -> DataFrame:
    """Dates from ``start`` to ``end`` inclusive; for a year column the years of the two dates count."""
    if col == "year":
        return articles.filter(F.expr("try_cast(year AS int)").between(int(start[:4]), int(end[:4])))
    return articles.filter(F.col(col).between(start, end))


def facet_filter(articles: DataFrame, facets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep rows that have one of the listed values in every facet; an empty list is no condition."""
    for name, values in facets.items():
        if not values:
            continue
        wanted = [v.lower() for v in values]
        if name not in articles.columns:
            raise ValueError(f"the articles have no facet {name!r}")
        if articles.schema[name].dataType.typeName() == "array":
            have = F.transform(name, F.lower)
            articles = articles.filter(F.arrays_overlap(have, F.array(*[F.lit(v) for v in wanted])))
        else:
            articles = articles.filter(F.lower(name).isin(wanted))
    return articles


# Options of a source that list wanted values, and the article column each is compared with.
OPTION_COLUMNS = {
    "languages": "language", "article_types": "publication_type", "species": "species", "subject_areas": "subject_area",
    "document_types": "document_type", "evidence_types": "evidence_type",
}


def with_options(articles: DataFrame, options: DataFrame) -> DataFrame:
    """Adds ``options``, the options of the article's source (one small row per source), null where it has none."""
    rows = options.select(F.col("source"), F.struct(*[c for c in options.columns if c != "source"]).alias("options"))
    return articles.join(rows, "source", "left")


def option_filter(articles: DataFrame) -> DataFrame:
    """Articles that their source's ``options`` let through: the source is on, the year in range, every list met.

    Blank options and empty lists are no condition. A list for a column that the articles lack is an error.
    """
    option = F.col("options")
    kept = articles.filter(F.coalesce(option["enabled"], F.lit(True)))
    year = F.expr("try_cast(year AS int)")
    for name, reaches in (("start", lambda own: year >= own), ("end", lambda own: year <= own)):
        own = F.substring(option["date_range"][name], 1, 4).try_cast("int")
        kept = kept.filter(own.isNull() | F.coalesce(reaches(own), F.lit(False)))
    for name, column in OPTION_COLUMNS.items():
        wanted = F.transform(option[name], F.lower)
        asked = F.coalesce(F.size(wanted) > 0, F.lit(False))
        if column not in articles.columns:
            problem = f"an option lists {name}, but the articles have no column {column!r}"
            kept = kept.filter(F.when(asked, F.raise_error(F.lit(problem)).cast("boolean")).otherwise(F.lit(True)))
            continue
        if articles.schema[column].dataType.typeName() == "array":
            met = F.arrays_overlap(F.transform(column, F.lower), wanted)
        else:
            met = F.array_contains(wanted, F.lower(tx.text(column)))
        kept = kept.filter(~asked | F.coalesce(met, F.lit(False)))
    return kept


def source_caps(articles: DataFrame, caps: DataFrame | int) -> DataFrame:
    """Per source: _key (its name, null told apart), _cap and _last, the place (ord, entry_id) of the last article within it.

    ``caps``: source and max_results, or one number for all. Articles are put in ranges of (source, place), and the sizes of
    the ranges tell in which one a source's cap falls; only that one is ranked. So a source is spread over tasks whatever its
    cap is. _last is null where the source has no more articles than that.
    """
    place = F.struct("ord", "entry_id").alias("_place")
    dealt = articles.select(_source_key(), place).repartitionByRange("_key", "_place")
    dealt = checkpoint(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_range"))  # a row per range
    sizes = sizes.withColumn("_upto", upto)
    if isinstance(caps, int):
        wanted = sizes.select("_key").distinct().withColumn("_cap", F.lit(caps))
    else:
        wanted = caps.select(_source_key(), F.col("max_results").alias("_cap")).filter(F.col("_cap").isNotNull())
    before = F.col("_upto") - F.col("_n")
    cut = sizes.join(wanted, "_key").filter((F.col("_upto") > F.col("_cap")) & (before < F.col("_cap")))
    cut = cut.select("_key", "_range", (F.col("_cap") - before).alias("_left"))
    in_range = F.row_number().over(Window.partitionBy("_key", "_range").orderBy("_place"))
    last = dealt.join(cut, ["_key", "_range"]).withColumn("_rank", in_range).filter(F.col("_rank") == F.col("_left"))
    # a source whose cap falls on the end of a range has its last article there
    even = sizes.join(wanted, "_key").filter((F.col("_upto") == F.col("_cap"))).select("_key", "_range")
    ends = dealt.join(even, ["_key", "_range"]).groupBy("_key").agg(F.max("_place").alias("_last"))
    last = last.select("_key", F.col("_place").alias("_last")).unionByName(ends)
    return checkpoint(wanted.join(last, "_key", "left"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("_key")


def limit_results(articles: DataFrame, max_results: DataFrame | int) -> DataFrame:
    """The first ``max_results`` articles of each source, by ord and then entry id.

    A number for all sources, or a table of source and max_results; a source without one is not cut. The articles meet one
    row per source.
    """
    caps = source_caps(articles, max_results)
    met = articles.withColumn("_key", _source_key()).join(caps, "_key", "left")
    place = F.struct("ord", "entry_id")
    inside = F.coalesce((F.col("_cap") > 0) & (F.col("_last").isNull() | (place <= F.col("_last"))), F.lit(True))
    return met.filter(F.when(F.col("_cap").isNull(), F.lit(True)).otherwise(inside)).drop("_key", "_cap", "_last")


def enabled_source_filter(articles: DataFrame, enabled: Mapping[str, bool]) -> DataFrame:
    """Drop articles of sources switched off; sources that are not mentioned are on."""
    off = [name for name, on in enabled.items() if not on]
    return articles.filter(~F.col("source").isin(off)) if off else articles


def lookup_by_id(articles: DataFrame, ids: DataFrame, id_type: str = "embase") -> DataFrame:
    """Articles whose identifier of kind ``id_type`` is in the ``id`` column of ``ids``."""
    if id_type not in ID_COLUMNS:
        raise ValueError(f"articles cannot be looked up by {id_type!r}; known kinds: {sorted(ID_COLUMNS)}")
    if ID_COLUMNS[id_type] not in articles.columns:
        raise ValueError(f"the articles have no column {ID_COLUMNS[id_type]!r}")
    wanted = ids.select(F.col("id").alias(ID_COLUMNS[id_type]))
    return articles.join(wanted, ID_COLUMNS[id_type], "left_semi")


def drop_empty_text(articles: DataFrame, *parts: str) -> DataFrame:
    """Articles with something to score, with the cleaned text in ``clean``."""
    parts = parts or ("title", "abstract", "keywords")
    return articles.filter(tx.has_words(*parts)).withColumn("clean", tx.clean_text(*parts))


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def source_counts(articles: DataFrame) -> DataFrame:
    """Articles per source and the combined total. The total adds up the per-source counts."""
    per_source = articles.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = per_source.agg(F.lit("combined").alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return per_source.unionByName(total)
