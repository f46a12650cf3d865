"""Scans and sinks: files written from the articles by Spark are read back and compared with the articles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..operators import filters, rules
from ..plans import combine
from ..schema import screening_view
from ..session import scratch_path
from ..sources import bibtex, databases, settings, tables
from ..sources.tables import EXCLUSION, INCLUSION
from .registry import LABELS_CTE, query, sql_squeeze, with_articles
from .table_queries import SCREENED_CTE, STRATEGY, STRATEGY_SQL, screened

# braces of a value survive only in pairs, white space is squeezed by the BibTeX reader
_SAFE = (
    "CASE WHEN len(regexp_extract_all({0}, '\\{{')) = len(regexp_extract_all({0}, '\\}}')) "
    "AND NOT regexp_matches({0}, '^[^{{]*\\}}') THEN {0} ELSE regexp_replace({0}, '[{{}}]', '', 'g') END"
)


def _read_back(x: str) -> str:
    return sql_squeeze(_SAFE.format(x))


def _bib_columns(articles: DataFrame) -> DataFrame:
    return articles.withColumn("keywords_str", F.col("keywords")).drop("keywords")


BIB_SELECT = (
    f"{_read_back('title')} AS title, {_read_back('abstract')} AS abstract, year, doi, "
    f"{_read_back('author')} AS author, journal, keywords"
)
BIB_FIELDS = ["title", "abstract", "year", "doi", "author", "journal", "keywords"]


@query(
    "scan_bibtex",
    with_articles(f"SELECT source || '_' || entry_id AS entry_id, source, {BIB_SELECT} FROM articles"),
)
def scan_bibtex(spark, sf_dir):
    """One file set per source, named after it."""
    out = scratch_path(spark, "bib")
    rows = _bib_columns(tables.articles(spark, sf_dir))
    names = {bib: F.col(c) for bib, c in bibtex.COLUMNS.items() if c in rows.columns}
    text = bibtex.bibtex_entry(F.col("entry_type"), F.col("entry_id"), {**names, "keywords": F.col("keywords_str")})
    rows.select(text.alias("value"), "source").write.partitionBy("source").text(out)
    scanned = bibtex.scan_bibtex(spark, f"{out}/*/part-*", prefix_keys=False)
    by_folder = F.col("ord.file")
    source = F.regexp_extract(by_folder, "source=([^/]*)", 1)
    scanned = screening_view(scanned)
    return scanned.select(F.concat(source, F.lit("_"), "entry_id").alias("entry_id"), source.alias("source"), *BIB_FIELDS)


@query("write_bibtex", with_articles(f"SELECT entry_id, {BIB_SELECT} FROM articles"))
def write_bibtex(spark, sf_dir):
    out = scratch_path(spark, "bib")
    bibtex.write_bibtex(_bib_columns(tables.articles(spark, sf_dir)), out)
    scanned = screening_view(bibtex.scan_bibtex(spark, f"{out}/part-*", prefix_keys=False))
    return scanned.select("entry_id", *BIB_FIELDS)


def _xml(value: Column) -> Column:
    """Text made safe for an XML element."""
    printable = F.regexp_replace(value, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        printable = F.replace(printable, F.lit(plain), F.lit(coded))
    return printable


def _element(name: str, value: Column, attributes: str = "") -> Column:
    body = F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))
    return F.when(value != "", body).otherwise("")


def _marked(value: Column) -> Column:
    """Inline markup around words that start with a letter from a to m, nested from g on."""
    marked = F.regexp_replace(value, r"(?<= )([a-fA-F][a-z]*)(?= )", "<i>$1</i>")
    return F.regexp_replace(marked, r"(?<= )([g-mG-M][a-z]*)(?= )", '<sup><b class="x">$1</b></sup>')


def pubmed_files(spark, sf_dir) -> str:
    """Bulk record XML of all articles, written by Spark."""
    people = F.array_join(
        F.transform(
            "authors",
            lambda a: F.concat(
                F.lit("<Author>"), _element("LastName", _xml(a["last_name"])), _element("ForeName", _xml(a["first_name"])),
                F.lit("<AffiliationInfo><Affiliation>"), F.col("source"),
                F.lit("</Affiliation></AffiliationInfo></Author>"),
            ),
        ),
        "",
    )
    record = F.concat(
        F.lit('<PubmedArticle><MedlineCitation><PMID Version="1">'), F.col("ord").cast("string"), F.lit("</PMID><Article>"),
        _element("ArticleTitle", _marked(_xml(F.col("title")))),
        F.lit("<Journal>"), _element("Title", F.col("journal")),
        F.lit("<JournalIssue><PubDate>"), _element("Year", F.col("year")), F.lit("</PubDate></JournalIssue></Journal>"),
        _element("ELocationID", F.col("doi"), ' EIdType="doi"'),
        F.lit("<Abstract>"), _element("AbstractText", _marked(_xml(F.col("abstract"))), ' Label="TEXT"'), F.lit("</Abstract>"),
        F.lit("<AuthorList>"), people, F.lit("</AuthorList>"),
        F.lit('<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType><PublicationType UI="D2">'),
        F.col("keywords"), F.lit("</PublicationType></PublicationTypeList></Article>"),
        F.lit('<KeywordList Owner="N"><Keyword><i>'), F.col("keywords"), F.lit("</i></Keyword></KeywordList>"),
        F.lit("</MedlineCitation></PubmedArticle>"),
    )
    out = scratch_path(spark, "xml")
    tables.articles(spark, sf_dir).select(record.alias("value")).write.text(out)
    return out


@query(
    "scan_pubmed",
    with_articles(
        r"""SELECT CAST(ord AS VARCHAR) AS pmid, title, journal, coalesce(nullif(year, ''), '1999') AS year, doi,
          CASE WHEN len(authors) = 0 THEN '' ELSE author END AS author, keywords,
          'TEXT: ' || ABSTRACT_READ AS abstract
        FROM articles""".replace("ABSTRACT_READ", "regexp_replace(abstract, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")
    ),
)
def scan_pubmed(spark, sf_dir):
    rows = databases.scan_pubmed(spark, pubmed_files(spark, sf_dir), "1999")
    return rows.select("pmid", "title", "journal", "year", "doi", "author", "abstract", F.col("keywords_str").alias("keywords"))


@query(
    "extract_authors",
    with_articles(
        """SELECT pmid, pos, a.last_name AS last_name, a.first_name AS first_name, source AS affiliation
        FROM (SELECT CAST(ord AS VARCHAR) AS pmid, source, unnest(authors) AS a, unnest(range(len(authors))) AS pos
              FROM articles)"""
    ),
)
def extract_authors(spark, sf_dir):
    rows = databases.scan_pubmed(spark, pubmed_files(spark, sf_dir), "1999")
    people = F.posexplode("authors").alias("pos", "a")
    return rows.select("pmid", people).select(
        "pmid", F.col("pos").cast("long").alias("pos"), "a.last_name", "a.first_name", "a.affiliation"
    )


@query(
    "publication_types",
    with_articles("SELECT CAST(ord AS VARCHAR) AS pmid, 'Journal Article, ' || keywords AS publication_type FROM articles"),
)
def publication_types(spark, sf_dir):
    rows = databases.scan_pubmed(spark, pubmed_files(spark, sf_dir), "1999")
    return rows.select("pmid", F.array_join("publication_type", ", ").alias("publication_type"))


@query(
    "scan_scopus",
    with_articles(
        """SELECT 'scopus_' || CASE WHEN doi <> '' THEN replace(doi, '/', '_') ELSE CAST(ord AS VARCHAR) END AS entry_id,
          CAST(ord AS VARCHAR) AS scopus_id, title, year, doi, journal, '0' AS citation_count FROM articles"""
    ),
)
def scan_scopus(spark, sf_dir):
    entry = F.struct(
        F.col("title").alias("dc:title"),
        F.concat(F.lit("SCOPUS_ID:"), F.col("ord").cast("string")).alias("dc:identifier"),
        F.col("doi").alias("prism:doi"),
        F.when(F.col("year") != "", F.concat("year", F.lit("-05-01"))).alias("prism:coverDate"),
        F.col("journal").alias("prism:publicationName"),
    )
    page = F.struct(F.lit("1").alias("opensearch:totalResults"), F.array(entry).alias("entry"))
    out = scratch_path(spark, "json")
    tables.articles(spark, sf_dir).select(page.alias("search-results")).write.json(out)
    rows = databases.scan_scopus(spark, out)
    return rows.select("entry_id", "scopus_id", "title", "year", "doi", "journal", "citation_count")


@query(
    "scan_embase",
    with_articles(
        """SELECT CAST(ord AS VARCHAR) AS embase_id, title, abstract, year, doi, author, '5-' || year AS pages,
          keywords || ', ' || source || ', ' || entry_type AS keywords FROM articles"""
    ),
)
def scan_embase(spark, sf_dir):
    people = F.transform(
        "authors", lambda a: F.struct(a["last_name"].alias("surname"), a["first_name"].alias("given_name"))
    )
    entry = F.struct(
        F.col("ord").cast("string").alias("embase_id"), "title", "abstract", "doi",
        F.struct(F.col("journal").alias("title")).alias("journal"),
        F.lit("5").alias("startingPage"), F.nullif(F.col("year"), F.lit("")).alias("endingPage"),
        F.when(F.col("year") != "", F.concat("year", F.lit("-01-02"))).alias("publicationDate"),
        people.alias("authors"), F.array("keywords").alias("keywords"), F.array("source").alias("mesh_terms"),
        F.array(F.struct(F.col("entry_type").alias("term"))).alias("emtree_terms"),
    )
    out = scratch_path(spark, "json")
    tables.articles(spark, sf_dir).select(F.struct(F.array(entry).alias("entry")).alias("results")).write.json(out)
    rows = databases.scan_embase(spark, out)
    return rows.select(
        "embase_id", "title", "abstract", "year", "doi", "author", "pages", F.col("keywords_str").alias("keywords")
    )


@query("scan_seed_labels", f"WITH {LABELS_CTE.strip()} SELECT entry_id, label FROM seed_labels")
def scan_seed_labels(spark, sf_dir):
    out = scratch_path(spark, "csv")
    sinks.write_table(tables.seed_labels(spark, sf_dir), out)
    return settings.scan_seed_labels(spark, out).select("entry_id", "label")


def _settings_file(spark, content: dict) -> str:
    out = scratch_path(spark, "settings")
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(out)
    return out


@query(
    "scan_criteria",
    with_articles("SELECT reason, count(*) AS n FROM screened GROUP BY reason", SCREENED_CTE),
)
def scan_criteria(spark, sf_dir):
    """Criteria are read from a settings file and decide all articles."""
    lists = {"inclusion_criteria": INCLUSION, "exclusion_criteria": EXCLUSION}
    criteria = settings.scan_criteria(spark, _settings_file(spark, {"screening": {"title_abstract": lists}}))
    phrases = [settings.criteria_phrases(criteria, kind) for kind in ("exclusion", "inclusion")]
    results = rules.rule_screen(tables.articles(spark, sf_dir), *phrases)
    return results.groupBy("reason").agg(F.count("*").alias("n"))


@query("scan_strategy", with_articles(f"SELECT entry_id FROM articles WHERE {STRATEGY_SQL}"))
def scan_strategy(spark, sf_dir):
    """Search terms are read from a settings file and filter all articles."""
    content = {"search_strategy": {
        "search_terms": STRATEGY, "boolean_operators": {"within_category": "OR", "between_categories": "AND"}}}
    terms = settings.scan_strategy(spark, _settings_file(spark, content))
    wanted: dict[str, list[str]] = {}
    for row in terms.orderBy("category", "ordinal").collect():
        wanted.setdefault(row["category"], []).append(row["term"])
    return filters.strategy_filter(tables.articles(spark, sf_dir), wanted).select("entry_id")


OPTIONS = {
    "database_defaults": {"date_range": {"start": "2001-01-01", "end": "2018-12-31"}, "languages": ["EN", "fr", "es"], "max_results": 25},
    "databases": {
        "src0": {"max_results": 3}, "src1": {"languages": ["de"], "max_results": 1000}, "src2": {"enabled": False},
        "src3": {"date_range": {"start": "2010-06-01", "end": "2012-01-31"}}, "src4": {"fields": ["title"], "article_types": ["Review", "ARTICLE"]},
        "src5": {"article_types": ["review"]}, "src6": {"max_results": 0}, "src7": {"languages": [], "date_range": {"start": "2015-01-01"}},
    },
}


def _own(source: str, option: str, default: str) -> str:
    return f"CASE WHEN source = '{source}' THEN {option} ELSE {default} END"


_FROM = _own("src3", "2010", _own("src7", "2015", "2001"))
_TO = _own("src3", "2012", _own("src7", "NULL", "2018"))
_CAP = _own("src0", "3", _own("src1", "1000", _own("src6", "0", "25")))
_STRATEGY_IN_TITLE = STRATEGY_SQL.replace("title || chr(10) || abstract || chr(10) || keywords", "title")


@query(
    "combine_sources_by_options",
    with_articles(
        rf"""SELECT source, entry_id FROM articles
        WHERE source <> 'src2' AND source <> 'src5' AND TRY_CAST(year AS INT) >= {_FROM} AND (TRY_CAST(year AS INT) <= {_TO} OR source = 'src7')
          AND (source = 'src7' OR (source = 'src1' AND keywords = 'de') OR (source <> 'src1' AND keywords IN ('en', 'fr', 'es')))
          AND (CASE WHEN source = 'src4' THEN {_STRATEGY_IN_TITLE} ELSE {STRATEGY_SQL} END)
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= {_CAP}"""
    ),
)
def combine_sources_by_options(spark, sf_dir):
    """The options of every source are read from a settings file: caps, date ranges, lists, fields and switches differ."""
    rows = tables.articles(spark, sf_dir).withColumn("language", F.col("keywords")).withColumn("publication_type", F.array("entry_type"))
    names = [f"src{k}" for k in range(20)]
    options = settings.scan_source_options(spark, _settings_file(spark, OPTIONS), names)
    return combine.search(rows, combine.Search(strategy=STRATEGY, options=options)).select("source", "entry_id")


@query("write_table", with_articles("SELECT entry_id, title, abstract, year, author FROM articles"))
def write_table(spark, sf_dir):
    out = scratch_path(spark, "json")
    sinks.write_table(tables.articles(spark, sf_dir).select("entry_id", "title", "abstract", "year", "author"), out, "json")
    return spark.read.schema("entry_id string, title string, abstract string, year string, author string").json(out)


@query(
    "write_decision_subsets",
    with_articles(f"SELECT decision, entry_id, {_read_back('author')} AS author FROM screened", SCREENED_CTE),
)
def write_decision_subsets(spark, sf_dir):
    out = scratch_path(spark, "subsets")
    sinks.write_decision_subsets(screened(spark, sf_dir), out)
    folders = F.create_map(*[x for d, name in sinks.SUBSETS.items() for x in (F.lit(name), F.lit(d))])
    rows = bibtex.scan_bibtex(spark, f"{out}/*/part-*", prefix_keys=False)
    folder = F.element_at(F.split("ord.file", "/"), -2)
    return rows.select(folders[folder].alias("decision"), "entry_id", "author")

