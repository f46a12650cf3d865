"""Bulk record files of the three literature databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records
from ..functions import text as tx
from ..schema import position, to_articles

# Fixed value: address of a record page.
PUBMED_URL = "https://pubmed.ncbi.nlm.nih.gov/"

# Tags around one record.
RECORD_START, RECORD_END = r"(?s)<PubmedArticle[\s>].*", "</PubmedArticle>"

# Inline elements that may stand inside titles, abstracts and keywords.
INLINE = ["b", "i", "em", "strong", "u", "sub", "sup", "DispFormula"]

_TAGGED = "struct<_VALUE:string>"
PUBMED_SCHEMA = f"""
MedlineCitation struct<
  PMID: {_TAGGED},
  Article: struct<
    ArticleTitle: string,
    Language: array<string>,
    Journal: struct<Title: string, JournalIssue: struct<Volume: string, Issue: string,
      PubDate: struct<Year: string, MedlineDate: string>>>,
    Pagination: struct<MedlinePgn: string>,
    ELocationID: array<struct<_EIdType: string, _VALUE: string>>,
    Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, Initials: string,
      AffiliationInfo: array<struct<Affiliation: string>>>>>,
    PublicationTypeList: struct<PublicationType: array<{_TAGGED}>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: {_TAGGED}>>>,
  KeywordList: array<struct<Keyword: array<{_TAGGED}>>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>
"""

SCOPUS_SCHEMA = """
`search-results` struct<`opensearch:totalResults`: string, entry: array<struct<
  `dc:title`: string, `dc:identifier`: string, eid: string, `prism:doi`: string, `prism:url`: string,
  `prism:publicationName`: string, `prism:volume`: string, `prism:issueIdentifier`: string,
  `prism:pageRange`: string, `citedby-count`: string, `source-id`: string, subtypeDescription: string,
  `prism:coverDate`: string, `dc:creator`: string>>>
"""

EMBASE_SCHEMA = """
results struct<totalResults: string, entry: array<struct<
  embase_id: string, title: string, abstract: string, doi: string, url: string,
  journal: struct<title: string, volume: string, issue: string>, startingPage: string, endingPage: string,
  publicationType: string, publicationDate: string, pubmed_id: string,
  pii: string, lui: string, medline: string, language: string, species: string, subject_area: string, evidence_type: string,
  authors: array<struct<surname: string, given_name: string, initials: string, affiliation: string>>,
  keywords: array<string>, mesh_terms: array<string>, emtree_terms: array<string>>>>
"""


def _in_page(source: str) -> dict:
    """Source and position of records that sit in a list of a page."""
    place = position(F.lit(source), *[F.col(c) for c in ("file", "block", "page", "at")])
    return {"source": source, "ord_": place}


def _pages(spark: SparkSession, path: str, schema: str, root: str, multi_line: bool) -> DataFrame:
    """One row per record of every result page. A page that is not JSON or has no record list is an error naming its file.

    A page may hold one record as an object instead of a list; a page that reports no results may leave the list out.
    """
    entries = T.StructType.fromDDL(schema)[root].dataType["entry"].dataType
    pages = spark.read.text(path, wholetext=multi_line)
    member = lambda name: F.get_json_object("value", f"$['{root}']['{name}']")
    total = F.coalesce(member("opensearch:totalResults"), member("totalResults"))
    raw = F.coalesce(member("entry"), F.when(total == "0", F.lit("[]")))
    listed = F.when(F.startswith(raw, F.lit("{")), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    pages = pages.filter(F.trim(F.translate("value", "\r\n\t", "   ")) != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("page"),
        F.hex(F.xxhash64("value")).alias("digest"),
        F.from_json(listed, entries).alias("entries"),
    )
    hint = "" if multi_line else " (one page per line is expected; use multi_line for a page per file)"
    problem = F.concat(F.lit("no readable result page in "), F.col("file"), F.lit(hint))
    checked = F.when(F.col("entries").isNull(), F.raise_error(problem).cast(entries)).otherwise(F.col("entries"))
    return pages.select("file", "block", "page", "digest", F.posexplode(checked).alias("at", "e"))


def without_inline_markup(record: Column) -> Column:
    """A record without the tags of inline elements and formulas; the text inside them stays where it is."""
    names = "|".join([*INLINE, "mml:[A-Za-z]+"])
    return F.regexp_replace(record, rf"</?(?:{names})(?:\s[^<>]*)?/?>", "")


def scan_pubmed(spark: SparkSession, path: str, default_year: str, source: str = "pubmed") -> DataFrame:
    """Articles of bulk record XML. ``default_year`` stands in where a record has no year at all.

    The text scan cuts files at the end tag of a record, so one large file is read by many tasks; a record that
    is not well formed is an error. Titles, abstracts and keywords keep all their text: inline tags go, what they
    enclose stays.
    """
    cut = spark.read.option("lineSep", RECORD_END).text(path)
    record = F.regexp_extract("value", RECORD_START, 0)
    rows = (
        cut.select(
            record.alias("record"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("number"),
        )
        .filter(F.col("record") != "")
        .withColumn("r", F.from_xml(F.concat(without_inline_markup(F.col("record")), F.lit(RECORD_END)), PUBMED_SCHEMA, {"mode": "FAILFAST"}))
        .select("file", "block", "number", "r.*")
    )
    article = F.col("MedlineCitation.Article")
    issue = article["Journal"]["JournalIssue"]
    pmid = tx.text(F.col("MedlineCitation.PMID._VALUE"))
    year = records.year_from_medline(issue["PubDate"]["Year"], issue["PubDate"]["MedlineDate"], default_year)
    authors = F.transform(
        article["AuthorList"]["Author"],
        lambda a: records.person(
            a["LastName"], a["ForeName"], a["Initials"], F.get(a["AffiliationInfo"], F.lit(0))["Affiliation"]
        ),
    )
    words = F.filter(
        records.collect_keywords(
            F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"]["_VALUE"]),
            F.transform(F.flatten(F.col("MedlineCitation.KeywordList.Keyword")), lambda k: k["_VALUE"]),
        ),
        lambda k: k.isNotNull(),
    )
    return to_articles(
        rows,
        source,
        position(F.lit(source), *[F.col(c) for c in ("file", "block", "number")]),
        F.concat(F.lit(f"{source}_"), records.author_year_key(authors, year, pmid)),
        title=article["ArticleTitle"],
        abstract=records.structured_abstract(article["Abstract"]["AbstractText"]),
        journal=article["Journal"]["Title"],
        year=year,
        volume=issue["Volume"],
        issue=issue["Issue"],
        pages=article["Pagination"]["MedlinePgn"],
        doi=records.extract_doi(article["ELocationID"], F.col("PubmedData.ArticleIdList.ArticleId")),
        url=F.concat(F.lit(PUBMED_URL), pmid, F.lit("/")),
        authors=authors,
        keywords=words,
        publication_type=F.transform(
            article["PublicationTypeList"]["PublicationType"], lambda p: p["_VALUE"]
        ),
        pmid=pmid,
        pii=records.extract_doi(article["ELocationID"], F.col("PubmedData.ArticleIdList.ArticleId"), "pii"),
        medline=pmid,
        language=F.array_join(article["Language"], ", "),
    )


def scan_scopus(spark: SparkSession, path: str, source: str = "scopus", multi_line: bool = False) -> DataFrame:
    """Articles of search result pages in JSON (one page per line, or per file with ``multi_line``)."""
    e = F.col("e")
    rows = _pages(spark, path, SCOPUS_SCHEMA, "search-results", multi_line)
    scopus_id = records.strip_id_prefix(e["dc:identifier"])
    authors = records.split_creator(e["dc:creator"])
    position = F.concat_ws("-", F.lower("digest"), "at")  # of the page's text: the same however files are split
    return to_articles(
        rows,
        **_in_page(source),
        entry_id=records.identifier_key(e["prism:doi"], scopus_id, position),
        title=e["dc:title"],
        journal=e["prism:publicationName"],
        year=records.year_from_date(e["prism:coverDate"]),
        volume=e["prism:volume"],
        issue=e["prism:issueIdentifier"],
        pages=e["prism:pageRange"],
        doi=e["prism:doi"],
        url=e["prism:url"],
        authors=authors,
        author=records.format_authors_or_creator(authors, tx.text(e["dc:creator"])),
        scopus_id=scopus_id,
        eid=e["eid"],
        source_id=e["source-id"],
        citation_count=F.coalesce(e["citedby-count"], F.lit("0")),
        document_type=e["subtypeDescription"],
        publication_date=e["prism:coverDate"],
    )


def _term(value):
    """A term given as text or as an object with a ``term`` member."""
    return F.when(value.startswith("{"), F.get_json_object(value, "$.term")).otherwise(value)


def scan_embase(spark: SparkSession, path: str, source: str = "embase", multi_line: bool = False) -> DataFrame:
    """Articles of result pages in JSON; terms may be plain text or objects."""
    e = F.col("e")
    rows = _pages(spark, path, EMBASE_SCHEMA, "results", multi_line)
    year = records.year_from_date(e["publicationDate"])
    authors = F.transform(
        e["authors"], lambda a: records.person(a["surname"], a["given_name"], a["initials"], a["affiliation"])
    )
    words = records.collect_keywords(
        e["keywords"], F.transform(e["mesh_terms"], _term), F.transform(e["emtree_terms"], _term)
    )
    return to_articles(
        rows,
        **_in_page(source),
        entry_id=F.concat(F.lit(f"{source}_"), records.author_year_key(authors, year, e["embase_id"])),
        title=e["title"],
        abstract=e["abstract"],
        journal=e["journal"]["title"],
        year=year,
        volume=e["journal"]["volume"],
        issue=e["journal"]["issue"],
        pages=records.page_range(e["startingPage"], e["endingPage"]),
        doi=e["doi"],
        url=e["url"],
        authors=authors,
        keywords=F.filter(words, lambda k: k.isNotNull()),
        publication_type=F.when(tx.text(e["publicationType"]) != "", F.array(e["publicationType"])),
        embase_id=e["embase_id"],
        pubmed_id=e["pubmed_id"],
        **{name: e[name] for name in ("pii", "lui", "medline", "language", "species", "subject_area", "evidence_type")},
        publication_date=e["publicationDate"],
    )
