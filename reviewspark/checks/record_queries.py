"""Record normalisation over the article table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import records
from ..functions import text as tx
from ..operators import rules
from ..sources import tables
from .registry import CLEAN, query, sql_author_key, sql_doi, sql_split, sql_strip, sql_title, with_articles


@query(
    "year_from_medline",
    with_articles(
        r"SELECT entry_id, coalesce(nullif(year, ''), nullif(regexp_extract(abstract, '\d{4}', 0), ''), '1999') AS year "
        "FROM articles"
    ),
)
def year_from_medline(spark, sf_dir):
    year = records.year_from_medline(F.nullif(F.col("year"), F.lit("")), "abstract", "1999")
    return tables.articles(spark, sf_dir).select("entry_id", year.alias("year"))


@query(
    "year_from_date",
    """SELECT o_orderkey, split_part(strftime(o_orderdate, '%Y-%m-%d'), '-', 1) AS year FROM orders""",
)
def year_from_date(spark, sf_dir):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", records.year_from_date(date).alias("year"))


@query(
    "extract_doi",
    with_articles(
        "SELECT entry_id, CASE WHEN doi <> '' THEN doi WHEN keywords = 'en' THEN '10.2/' || ord ELSE '' END AS doi "
        "FROM articles"
    ),
)
def extract_doi(spark, sf_dir):
    def tagged(kind, name, value):
        return F.struct(F.lit(kind).alias(name), value.alias("_VALUE"))

    locations = F.filter(
        F.array(tagged("pii", "_EIdType", F.col("entry_id")), tagged("doi", "_EIdType", F.col("doi"))),
        lambda x: x["_VALUE"] != "",
    )
    ids = F.when(
        F.col("keywords") == "en",
        F.array(
            tagged("pubmed", "_IdType", F.col("entry_id")),
            tagged("doi", "_IdType", F.concat(F.lit("10.2/"), F.col("ord").cast("string"))),
        ),
    )
    rows = tables.articles(spark, sf_dir).select("entry_id", locations.alias("locations"), ids.alias("ids"))
    return rows.select("entry_id", records.extract_doi("locations", "ids").alias("doi"))


@query(
    "structured_abstract",
    with_articles(
        f"""SELECT entry_id, {sql_strip("array_to_string(list_transform(string_split(abstract, chr(10)), "
        "lambda s, i: CASE WHEN i % 2 = 1 THEN upper(keywords) || ': ' || s ELSE s END), chr(10))")} AS abstract
        FROM articles"""
    ),
)
def structured_abstract(spark, sf_dir):
    section = lambda s, i: F.struct(
        F.when(i % 2 == 0, F.upper("keywords")).alias("_Label"), s.alias("_VALUE")
    )
    sections = F.transform(F.split("abstract", "\n"), section)
    rows = tables.articles(spark, sf_dir).select("entry_id", sections.alias("sections"))
    return rows.select("entry_id", records.structured_abstract("sections").alias("abstract"))


_NAME_PARTS = sql_split("n")


@query(
    "split_creator",
    with_articles(
        f"""SELECT entry_id, pos,
          CASE WHEN len(p) > 1 THEN p[-1] ELSE n END AS last_name,
          CASE WHEN len(p) > 1 THEN array_to_string(p[1:-2], ' ') ELSE '' END AS first_name,
          CASE WHEN len(p) > 1 THEN array_to_string(list_transform(p[1:-2], lambda x: substr(x, 1, 1)), '') ELSE '' END
            AS initials
        FROM (SELECT entry_id, pos, names[pos + 1] AS n, {sql_split("names[pos + 1]")} AS p
              FROM (SELECT *, unnest(range(len(names))) AS pos FROM (
                SELECT entry_id, list_filter(string_split(
                  regexp_replace(title, '([^ ]+ [^ ]+) ', '\\1, ', 'g'), ', '), lambda x: x <> '') AS names
                FROM articles)))"""
    ),
)
def split_creator(spark, sf_dir):
    creator = F.regexp_replace("title", "([^ ]+ [^ ]+) ", "$1, ")
    people = F.posexplode(records.split_creator(creator)).alias("pos", "p")
    rows = tables.articles(spark, sf_dir).select("entry_id", people)
    return rows.select("entry_id", F.col("pos").cast("long").alias("pos"), "p.last_name", "p.first_name", "p.initials")


@query("strip_id_prefix", with_articles("SELECT entry_id, CAST(ord AS VARCHAR) AS scopus_id FROM articles"))
def strip_id_prefix(spark, sf_dir):
    tagged = F.concat(F.lit("SCOPUS_ID:"), F.col("ord").cast("string"))
    return tables.articles(spark, sf_dir).select("entry_id", records.strip_id_prefix(tagged).alias("scopus_id"))


@query(
    "page_range",
    with_articles(
        "SELECT entry_id, coalesce(nullif(year, ''), '') || '-' || coalesce(nullif(doi, ''), '') AS pages FROM articles"
    ),
)
def page_range(spark, sf_dir):
    blank_to_missing = [F.nullif(F.col(c), F.lit("")) for c in ("year", "doi")]
    return tables.articles(spark, sf_dir).select("entry_id", records.page_range(*blank_to_missing).alias("pages"))


@query(
    "collect_keywords",
    with_articles(
        "SELECT entry_id, array_to_string(list_concat([keywords], CASE WHEN doi = '' THEN [] ELSE "
        "string_split(title, ' ') END, [source]), ', ') AS keywords FROM articles"
    ),
)
def collect_keywords(spark, sf_dir):
    middle = F.when(F.col("doi") != "", F.split("title", " "))
    lists = records.collect_keywords(F.array("keywords"), middle, F.array("source"))
    return tables.articles(spark, sf_dir).select("entry_id", F.array_join(lists, ", ").alias("keywords"))


@query(
    "format_authors",
    with_articles(
        """SELECT entry_id, author AS bibtex,
          array_to_string(list_transform(authors, lambda a: a.last_name || ', ' || a.first_name), ', ') AS listed,
          CASE WHEN author <> '' THEN author WHEN year <> '' THEN title ELSE 'Unknown Author' END AS with_fallback
        FROM articles"""
    ),
)
def format_authors(spark, sf_dir):
    creator = F.when(F.col("year") != "", F.col("title"))
    return tables.articles(spark, sf_dir).select(
        "entry_id",
        records.format_authors("authors").alias("bibtex"),
        records.format_authors("authors", ", ").alias("listed"),
        records.format_authors_or_creator("authors", creator).alias("with_fallback"),
    )


@query(
    "flatten_lists",
    with_articles(
        """SELECT entry_id,
          array_to_string(list_transform(authors, lambda a: a.last_name || ', ' || a.first_name), ', ') AS authors_str,
          array_to_string(string_split(title, ' '), ', ') AS keywords_str,
          entry_type || ', ' || keywords AS publication_type_str
        FROM articles"""
    ),
)
def flatten_lists(spark, sf_dir):
    rows = tables.articles(spark, sf_dir).select(
        "entry_id",
        "authors",
        F.split("title", " ").alias("keywords"),
        F.array("entry_type", "keywords").alias("publication_type"),
    )
    return records.flatten_lists(rows).select("entry_id", "authors_str", "keywords_str", "publication_type_str")


@query(
    "citation_key",
    with_articles(
        r"""SELECT entry_id,
          CASE WHEN len(authors) = 0 THEN 'unknown'
               ELSE regexp_replace(lower(authors[1].last_name), '[^\p{L}\p{N}]', '', 'g') END || year || '_' || ord
            AS author_year_key,
          'scopus_' || CASE WHEN doi <> '' THEN replace(doi, '/', '_') WHEN year <> '' THEN entry_id
                            ELSE CAST(ord + 1 AS VARCHAR) END AS identifier_key
        FROM articles"""
    ),
)
def citation_key(spark, sf_dir):
    record_id = F.when(F.col("year") != "", F.col("entry_id"))
    return tables.articles(spark, sf_dir).select(
        "entry_id",
        records.author_year_key("authors", "year", "ord").alias("author_year_key"),
        records.identifier_key("doi", record_id, F.col("ord") + 1).alias("identifier_key"),
    )


@query("strip_source_prefix", with_articles("SELECT entry_id, CAST(ord AS VARCHAR) AS original_key FROM articles"))
def strip_source_prefix(spark, sf_dir):
    key = records.strip_source_prefix("entry_id", "source")
    return tables.articles(spark, sf_dir).select("entry_id", key.alias("original_key"))


@query(
    "drop_blank_fields",
    with_articles(
        """SELECT entry_id, field, value FROM (
          SELECT entry_id, unnest(['title', 'year', 'doi', 'author']) AS field, unnest([title, year, doi, author]) AS value
          FROM articles) WHERE value <> ''"""
    ),
)
def drop_blank_fields(spark, sf_dir):
    names = ("title", "year", "doi", "author")
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    kept = F.explode(records.drop_blank_fields(fields)).alias("field", "value")
    return tables.articles(spark, sf_dir).select("entry_id", kept)


@query(
    "format_person",
    with_articles(
        """SELECT entry_id, array_to_string(list_transform(authors,
          lambda a: trim(a.first_name || ' ' || a.last_name)), ' and ') AS author FROM articles"""
    ),
)
def format_person(spark, sf_dir):
    return tables.articles(spark, sf_dir).select("entry_id", records.format_person("authors").alias("author"))


@query("normalize_doi", with_articles(f"SELECT entry_id, {sql_doi("'  ' || upper(doi) || chr(10)")} AS doi FROM articles"))
def normalize_doi(spark, sf_dir):
    messy = F.concat(F.lit("  "), F.upper("doi"), F.lit("\n"))
    return tables.articles(spark, sf_dir).select("entry_id", tx.normalize_doi(messy).alias("doi"))


@query(
    "normalize_title",
    with_articles(f"SELECT entry_id, {sql_title('title')} AS title_n, {sql_title('abstract')} AS abstract_n FROM articles"),
)
def normalize_title(spark, sf_dir):
    return tables.articles(spark, sf_dir).select(
        "entry_id", tx.normalize_title("title").alias("title_n"), tx.normalize_title("abstract").alias("abstract_n")
    )


@query(
    "author_key",
    with_articles(
        f"SELECT entry_id, {sql_author_key('author')} AS author_n, "
        f"{sql_author_key("replace(title, ' ', ' and ')")} AS words_n FROM articles"
    ),
)
def author_key(spark, sf_dir):
    return tables.articles(spark, sf_dir).select(
        "entry_id",
        tx.author_key("author").alias("author_n"),
        tx.author_key(F.replace(F.col("title"), F.lit(" "), F.lit(" and "))).alias("words_n"),
    )


@query("clean_text", with_articles(f"SELECT entry_id, {CLEAN} AS clean FROM articles"))
def clean_text(spark, sf_dir):
    return tables.articles(spark, sf_dir).select("entry_id", tx.clean_text("title", "abstract", "keywords").alias("clean"))


@query(
    "entry_projection",
    with_articles(
        """SELECT entry_id AS entry_key, entry_type, source, title, year, doi, journal,
          array_to_string(list_transform(authors, lambda a: a.last_name || ', ' || a.first_name), ', ') AS authors
        FROM articles"""
    ),
)
def entry_projection(spark, sf_dir):
    flat = sinks.entry_projection(tables.articles(spark, sf_dir).withColumn("keywords", F.array("keywords")))
    return flat.select("entry_key", "entry_type", "source", "title", "year", "doi", "journal", "authors")


@query(
    "result_projection",
    with_articles(
        """SELECT entry_id, title, author AS authors, year, journal, abstract,
          CASE WHEN p >= 0.5 THEN 'include' ELSE 'exclude' END AS decision, p AS probability,
          CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS confidence
        FROM (SELECT *, ((ord * 37) % 1000)::DOUBLE / 1000 AS p FROM articles)"""
    ),
)
def result_projection(spark, sf_dir):
    p = (F.col("ord") * 37 % 1000) / 1000
    scored = tables.articles(spark, sf_dir).withColumn("probability", p)
    return rules.result_projection(scored.withColumn("prediction", (p >= 0.5).cast("int")))
