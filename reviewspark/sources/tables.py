"""Articles, seed labels and criteria taken from the given test tables.

Every document is one article and keeps its whole text as the abstract. The tables carry no bibliography, so the
remaining fields are worked out from the text and the id: some articles lack a DOI or a year on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUSION = ["worthless", "license", "und der"]
INCLUSION = ["of the", "de la"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    first_sentence = F.regexp_extract("text", r"^[^\n.]*", 0)
    w = F.col("w")
    person = lambda last, first: F.struct(w[last].alias("last_name"), w[first].alias("first_name"))
    people = F.when(F.size(w) >= 4, F.array(person(1, 0), person(3, 2))).otherwise(
        F.array().cast("array<struct<last_name:string,first_name:string>>")
    )
    return (
        table(spark, sf_dir, "documents")
        .withColumn("w", F.split(F.regexp_replace(F.trim(first_sentence), " +", " "), " "))
        .withColumn("title", F.array_join("w", " "))
        .withColumn("authors", people)
        .select(
            doc.alias("ord"),
            F.concat("source", F.lit("_"), doc.cast("string")).alias("entry_id"),
            "source",
            F.lit("article").alias("entry_type"),
            "title",
            F.col("text").alias("abstract"),
            F.col("lang").alias("keywords"),
            F.when((doc % 7 == 0) | (doc % 11 == 0), "")
            .otherwise((2000 + F.length("title") % 20).cast("string"))
            .alias("year"),
            F.when(doc % 3 == 0, F.concat(F.lit("10.1000/"), F.md5("text"))).otherwise("").alias("doi"),
            "authors",
            F.array_join(
                F.transform("authors", lambda a: F.concat(a["last_name"], F.lit(", "), a["first_name"])), " and "
            ).alias("author"),
            F.concat(F.lit("Journal of "), "lang").alias("journal"),
        )
    )


ARTICLES_SQL = r"""
words AS (SELECT *, string_split(regexp_replace(trim(regexp_extract(text, '^[^\n.]*')), ' +', ' ', 'g'), ' ') AS w
          FROM documents),
articles AS (
  SELECT doc_id AS ord, source || '_' || doc_id AS entry_id, source, 'article' AS entry_type,
    array_to_string(w, ' ') AS title, text AS abstract, lang AS keywords,
    CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN ''
         ELSE CAST(2000 + length(array_to_string(w, ' ')) % 20 AS VARCHAR) END AS year,
    CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || md5(text) ELSE '' END AS doi,
    CASE WHEN len(w) >= 4 THEN [{'last_name': w[2], 'first_name': w[1]}, {'last_name': w[4], 'first_name': w[3]}]
         ELSE [] END AS authors,
    CASE WHEN len(w) >= 4 THEN w[2] || ', ' || w[1] || ' and ' || w[4] || ', ' || w[3] ELSE '' END AS author,
    'Journal of ' || lang AS journal
  FROM words)"""


def seed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as include (1) / exclude (0) labels; the id is that of the labelled article."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("entry_id"),
        F.col("quality").alias("label"),
    )


SEED_LABELS_SQL = """
seed_labels AS (SELECT d.source || '_' || d.doc_id AS entry_id, l.quality AS label
                FROM labels l JOIN documents d USING (doc_id))"""
