"""The article table every source is turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import records
from .functions import text as tx

TEXT_FIELDS = [
    "title", "abstract", "journal", "year", "volume", "issue", "pages", "doi", "url", "author",
    "pmid", "pubmed_id", "scopus_id", "eid", "embase_id", "source_id", "citation_count", "document_type",
    "publication_date", "pii", "lui", "medline", "language", "species", "subject_area", "evidence_type",
]
LIST_FIELDS = ["keywords", "publication_type"]

AUTHORS = f"array<{records.AUTHOR_TYPE}>"


def to_articles(df: DataFrame, source: str | Column, ord_: Column, entry_id: Column, **fields: Column) -> DataFrame:
    """Select the article columns. Fields that are not given are blank; missing text is the blank string."""
    source = F.lit(source) if isinstance(source, str) else source
    authors = F.coalesce(fields["authors"].cast(AUTHORS), records.no_people()) if "authors" in fields else records.no_people()
    fields.setdefault("author", records.format_authors(authors))
    lists = {
        name: F.coalesce(fields[name].cast("array<string>"), F.array().cast("array<string>"))
        if name in fields
        else F.array().cast("array<string>")
        for name in LIST_FIELDS
    }
    return df.select(
        entry_id.alias("entry_id"),
        source.alias("source"),
        ord_.alias("ord"),
        fields.get("entry_type", F.lit("article")).alias("entry_type"),
        *[tx.text(fields[name]).alias(name) if name in fields else F.lit("").alias(name) for name in TEXT_FIELDS],
        authors.alias("authors"),
        *[value.alias(name) for name, value in lists.items()],
        F.array_join(lists["keywords"], ", ").alias("keywords_str"),
        fields.get("extra", F.create_map().cast("map<string,string>")).alias("extra"),
    )


def position(source: Column, file: Column, block: Column, record: Column, item: Column | None = None) -> Column:
    """Place of a record: source name, file, file block, record in the block, item in the record."""
    item = F.lit(0) if item is None else item
    return F.struct(
        source.alias("source"),
        file.alias("file"),
        block.cast("bigint").alias("block"),
        record.cast("bigint").alias("record"),
        item.cast("bigint").alias("item"),
    )


def screening_view(articles: DataFrame) -> DataFrame:
    """Articles with keywords as one text, the form the text operators read."""
    return articles.drop("keywords").withColumnRenamed("keywords_str", "keywords")
