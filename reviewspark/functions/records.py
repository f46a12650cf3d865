"""Normalisation of source records: years, identifiers, people, keywords, citation keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

AUTHOR_TYPE = "struct<last_name:string,first_name:string,initials:string,affiliation:string,authid:string>"


def _as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- years, identifiers, pages -------------------------------------------------------------------------


def year_from_medline(year: Column | str, medline_date: Column | str, default_year: str) -> Column:
    """The given year, else the first four digits of the free-text date, else ``default_year``."""
    from_text = F.regexp_extract(tx.text(medline_date), r"\d{4}", 0)
    return F.coalesce(_as_col(year), F.nullif(from_text, F.lit("")), F.lit(default_year))


def year_from_date(date: Column | str) -> Column:
    """The text before the first dash of an ISO date."""
    return F.substring_index(tx.text(date), "-", 1)


def extract_doi(locations: Column | str, article_ids: Column | str, wanted: str = "doi") -> Column:
    """First electronic location of type doi (or another type), else first article id of that type, else blank."""

    def first(values: Column | str, kind: str) -> Column:
        return F.get(F.filter(_as_col(values), lambda x: x[kind] == wanted), F.lit(0))["_VALUE"]

    return F.coalesce(first(locations, "_EIdType"), first(article_ids, "_IdType"), F.lit(""))


def strip_id_prefix(col: Column | str, prefix: str = "SCOPUS_ID:") -> Column:
    return F.replace(tx.text(col), F.lit(prefix), F.lit(""))


def page_range(start: Column | str, end: Column | str) -> Column:
    return F.concat(tx.text(start), F.lit("-"), tx.text(end))


def structured_abstract(sections: Column | str) -> Column:
    """Labelled sections as 'Label: text' lines; unlabelled ones as plain lines."""

    def line(s: Column) -> Column:
        body = tx.text(s["_VALUE"])
        return F.when(s["_Label"].isNotNull(), F.concat(s["_Label"], F.lit(": "), body)).otherwise(body)

    return tx.strip(F.array_join(F.transform(_as_col(sections), line), "\n"))


# -- people --------------------------------------------------------------------------------------------


def person(last: Column, first: Column, initials: Column, affiliation: Column | None = None) -> Column:
    return F.struct(
        tx.text(last).alias("last_name"),
        tx.text(first).alias("first_name"),
        tx.text(initials).alias("initials"),
        (F.lit("") if affiliation is None else tx.text(affiliation)).alias("affiliation"),
        F.lit("").alias("authid"),
    )


def no_people() -> Column:
    return F.array().cast(f"array<{AUTHOR_TYPE}>")


def split_creator(creator: Column | str) -> Column:
    """People of a 'First Last, First Last' text: the last word is the last name."""

    def one(name: Column) -> Column:
        parts = F.filter(F.split(name, f"[{tx.SPACE}]+"), lambda w: w != "")
        many = F.size(parts) > 1
        leading = F.when(many, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
        return person(
            F.when(many, F.element_at(parts, -1)).otherwise(name),
            F.array_join(leading, " "),
            F.array_join(F.transform(leading, lambda p: F.substring(p, 1, 1)), ""),
        )

    return F.transform(F.filter(F.split(tx.text(creator), ", "), lambda n: n != ""), one)


def format_authors(authors: Column | str, separator: str = " and ") -> Column:
    """'Last, First' names joined by ``separator``."""
    return F.array_join(
        F.transform(_as_col(authors), lambda a: F.concat(a["last_name"], F.lit(", "), a["first_name"])), separator
    )


def format_authors_or_creator(authors: Column | str, creator: Column | str) -> Column:
    """Formatted people, else the raw creator text, else a placeholder when that field is missing."""
    names = F.nullif(format_authors(authors), F.lit(""))
    return F.coalesce(names, _as_col(creator), F.lit("Unknown Author"))


def format_person(authors: Column | str, separator: str = " and ") -> Column:
    """'First Last' names; a missing part leaves no extra space."""

    def one(a: Column) -> Column:
        parts = F.filter(F.array(a["first_name"], a["last_name"]), lambda p: p.isNotNull() & (p != ""))
        return F.array_join(parts, " ")

    return F.array_join(F.transform(_as_col(authors), one), separator)


# -- lists ---------------------------------------------------------------------------------------------


def collect_keywords(*lists: Column | str) -> Column:
    """The keyword lists one after another, repeated keywords kept, missing lists skipped."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(_as_col(c), empty) for c in lists])


def flatten_lists(df: DataFrame) -> DataFrame:
    """Add one text column per list column, for tables that cannot hold lists."""
    out = df
    if "authors" in df.columns:
        out = out.withColumn("authors_str", format_authors("authors", ", "))
    for name in ("keywords", "publication_type"):
        if name in df.columns:
            out = out.withColumn(f"{name}_str", F.array_join(name, ", "))
    return out


def drop_blank_fields(fields: Column | str) -> Column:
    """A field map without blank or missing values."""
    return F.map_filter(_as_col(fields), lambda _, v: v.isNotNull() & (v != ""))


# -- citation keys -------------------------------------------------------------------------------------


def first_author_word(authors: Column | str) -> Column:
    """Letters and digits of the first author's lower-case last name, 'unknown' when there is no author."""
    last = F.get(_as_col(authors), F.lit(0))["last_name"]
    return F.coalesce(F.regexp_replace(F.lower(last), r"[^\p{L}\p{N}]", ""), F.lit("unknown"))


def author_year_key(authors: Column | str, year: Column | str, suffix: Column | str) -> Column:
    return F.concat(first_author_word(authors), tx.text(year), F.lit("_"), tx.text(suffix))


def identifier_key(doi: Column | str, scopus_id: Column | str, position: Column | str) -> Column:
    """'scopus_' and the DOI with underscores for slashes, else the record id, else the 1-based position."""
    body = F.coalesce(
        F.nullif(F.replace(tx.text(doi), F.lit("/"), F.lit("_")), F.lit("")),
        F.nullif(tx.text(scopus_id), F.lit("")),
        tx.text(position),
    )
    return F.concat(F.lit("scopus_"), body)


def strip_source_prefix(key: Column | str, source: Column | str) -> Column:
    """The record's own key: what follows the source name and one underscore."""
    return F.substr(_as_col(key), F.length(_as_col(source)) + 2)
