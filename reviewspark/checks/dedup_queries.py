"""Duplicate passes over the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, exact, rules, similar
from ..sources import tables
from ..sources.tables import EXCLUSION, INCLUSION
from .registry import query, sql_author_key, sql_doi, sql_jaccard, sql_title, sql_words, with_articles
from .table_queries import SCREENED_CTE

BASE_CTE = f"""
base AS MATERIALIZED (SELECT entry_id, ord, {sql_doi('doi')} AS doi_n, {sql_title('title')} AS title_n, year,
    {sql_author_key('author')} AS author_n FROM articles)"""

DOI_SQL = f"""
SELECT primary_id, entry_id AS dup_id, 1.0::DOUBLE AS confidence, '{exact.DOI_REASON}' AS reason FROM (
  SELECT entry_id, first_value(entry_id) OVER (PARTITION BY doi_n ORDER BY ord) AS primary_id FROM base WHERE doi_n <> '')
WHERE entry_id <> primary_id"""

TITLE_SQL = f"""
SELECT primary_id, entry_id AS dup_id, 0.9::DOUBLE AS confidence, '{exact.TITLE_REASON}' AS reason FROM (
  SELECT entry_id, first_value(entry_id) OVER (PARTITION BY title_n, year ORDER BY ord) AS primary_id
  FROM base WHERE doi_n = '' AND title_n <> '' AND year <> '')
WHERE entry_id <> primary_id"""

WORDS = f"{sql_words('title_n')} AS tw, {sql_words('author_n')} AS aw"
KEPT_CTE = f"""
exact_pairs AS MATERIALIZED ({DOI_SQL} UNION ALL {TITLE_SQL}),
kept AS MATERIALIZED (
  SELECT entry_id, ord, CASE WHEN doi_n <> '' THEN 1 ELSE 2 END AS pass, year = '' AS no_year, {WORDS}
  FROM base WHERE (doi_n <> '' OR (title_n <> '' AND year <> ''))
    AND entry_id NOT IN (SELECT dup_id FROM exact_pairs)),
leftover AS MATERIALIZED (
  SELECT entry_id, ord, {WORDS}, row_number() OVER (ORDER BY ord) AS rn
  FROM base WHERE doi_n = '' AND title_n <> '' AND year = '')"""


def _scored(left: str, right: str, on: str) -> str:
    """Matches above 0.5 of leftovers against targets that have no_year, tw, aw, pass, ord and entry_id."""
    return f"""
SELECT * FROM (
  SELECT l_id, l_rn, t_id, t_rn, t_pass, t_ord,
    CASE WHEN no_year AND ts > 0.8 THEN ts WHEN NOT no_year AND ts > 0.8 AND au > 0.5 THEN (ts + au) / 2
         WHEN no_year AND ts > 0.5 AND ts <= 0.8 AND au > 0.7 THEN (ts + au) / 2 END AS score,
    CASE WHEN no_year AND ts > 0.8 THEN '{similar.REASON_YEAR}'
         WHEN NOT no_year AND ts > 0.8 AND au > 0.5 THEN '{similar.REASON_AUTHOR}'
         WHEN no_year AND ts > 0.5 AND ts <= 0.8 AND au > 0.7 THEN '{similar.REASON_BOTH}' END AS reason
  FROM (SELECT l.entry_id AS l_id, l.rn AS l_rn, t.entry_id AS t_id, t.rn AS t_rn, t.pass AS t_pass, t.ord AS t_ord,
          t.no_year, {sql_jaccard('l.tw', 't.tw')} AS ts, {sql_jaccard('l.aw', 't.aw')} AS au
        FROM {left} l JOIN {right} t ON {on}))
WHERE score > 0.5"""


OLD_TARGETS_CTE = "old_targets AS (SELECT *, 0 AS rn FROM kept WHERE len(tw) > 0)"

MATCHES_CTE = f"matches AS MATERIALIZED ({_scored('leftover', 'old_targets', 'TRUE')})"


@query("dedup_doi", with_articles(DOI_SQL, BASE_CTE))
def dedup_doi(spark, sf_dir):
    return exact.dedup_doi(tables.articles(spark, sf_dir)).drop("status")


@query("dedup_title_year", with_articles(TITLE_SQL, BASE_CTE))
def dedup_title_year(spark, sf_dir):
    return exact.dedup_title_year(tables.articles(spark, sf_dir)).drop("status")


@query(
    "fuzzy_match",
    with_articles(
        "SELECT l_id AS entry_id, t_id AS target_id, score, reason FROM matches",
        BASE_CTE, KEPT_CTE, OLD_TARGETS_CTE, MATCHES_CTE,
    ),
)
def fuzzy_match(spark, sf_dir):
    _, kept, leftovers = dedup.exact_passes(tables.articles(spark, sf_dir))
    return similar.fuzzy_match(leftovers, kept)


@query(
    "best_match",
    with_articles(
        """SELECT l_id AS entry_id, t_id AS target_id, score, reason FROM matches
        QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY score DESC, t_pass, t_ord) = 1""",
        BASE_CTE, KEPT_CTE, OLD_TARGETS_CTE, MATCHES_CTE,
    ),
)
def best_match(spark, sf_dir):
    _, kept, leftovers = dedup.exact_passes(tables.articles(spark, sf_dir))
    return similar.best_match(leftovers, kept)


# The near-duplicate rule goes through the leftovers in order; the recursion carries the numbers of those kept.
PAIRS_CTE = f"""
{OLD_TARGETS_CTE},
own_targets AS (SELECT entry_id, ord, 3 AS pass, TRUE AS no_year, tw, aw, rn FROM leftover),
edges AS MATERIALIZED ({_scored('leftover', 'old_targets', 'TRUE')}
  UNION ALL {_scored('leftover', 'own_targets', 't.rn < l.rn')}),
sure AS MATERIALIZED (
  SELECT rn, coalesce(bool_or(t_pass < 3), FALSE) AS sure_old,
    coalesce(list(t_rn) FILTER (t_pass = 3), []) AS sure_own
  FROM leftover LEFT JOIN (SELECT * FROM edges WHERE score > 0.7) ON l_rn = rn GROUP BY rn),
walk AS (
  SELECT 0::BIGINT AS rn, []::BIGINT[] AS chosen
  UNION ALL
  SELECT s.rn, CASE WHEN s.sure_old OR list_has_any(s.sure_own, w.chosen) THEN w.chosen
               ELSE list_append(w.chosen, s.rn) END
  FROM walk w JOIN sure s ON s.rn = w.rn + 1),
new_kept AS MATERIALIZED (SELECT unnest(chosen) AS rn FROM (SELECT chosen FROM walk ORDER BY rn DESC LIMIT 1)),
near AS (
  SELECT t_id AS primary_id, l_id AS dup_id, score AS confidence, reason FROM edges
  WHERE t_pass < 3 OR t_rn IN (SELECT rn FROM new_kept)
  QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY score DESC, t_pass, t_ord) = 1),
pairs AS MATERIALIZED (
  SELECT *, '{exact.CONFIRMED}' AS status FROM exact_pairs
  UNION ALL SELECT *, CASE WHEN confidence > 0.7 THEN '{exact.CONFIRMED}' ELSE '{similar.REVIEW}' END FROM near),
removed AS (SELECT dup_id FROM pairs WHERE status = '{exact.CONFIRMED}')"""


def _with_pairs(select: str, *ctes: str) -> str:
    return with_articles(select, BASE_CTE, KEPT_CTE, PAIRS_CTE, *ctes, recursive=True)


@query("deduplicate", _with_pairs("SELECT primary_id, dup_id, confidence, reason, status FROM pairs"))
def deduplicate(spark, sf_dir):
    return dedup.duplicate_pairs(tables.articles(spark, sf_dir))


@query(
    "unique_articles",
    _with_pairs("SELECT entry_id, title, year FROM articles WHERE entry_id NOT IN (SELECT dup_id FROM removed)"),
)
def unique_articles(spark, sf_dir):
    articles = tables.articles(spark, sf_dir)
    pairs = dedup.duplicate_pairs(articles)
    return dedup.unique_articles(articles.select("entry_id", "ord", "title", "year"), pairs)\
        .select("entry_id", "title", "year")


@query(
    "duplicate_report",
    _with_pairs(
        """SELECT a.source AS primary_source, a.title AS primary_title, a.author AS primary_authors, a.year AS primary_year,
          b.source AS duplicate_source, b.title AS duplicate_title, b.author AS duplicate_authors, b.year AS duplicate_year,
          confidence, reason, status
        FROM pairs JOIN articles a ON a.entry_id = primary_id JOIN articles b ON b.entry_id = dup_id"""
    ),
)
def duplicate_report(spark, sf_dir):
    articles = tables.articles(spark, sf_dir)
    return dedup.duplicate_report(articles, dedup.deduplicate(articles).pairs)


@query(
    "flow_counts",
    _with_pairs(
        f"""SELECT stage, n FROM (
          SELECT 'identified' AS stage, count(*) AS n FROM articles
          UNION ALL SELECT 'duplicates_removed', count(*) FROM removed
          UNION ALL SELECT 'borderline', count(*) FROM pairs WHERE status = '{similar.REVIEW}'
          UNION ALL SELECT 'unique', count(*) FROM left_over_articles
          UNION ALL SELECT 'screened', count(*) FROM left_over_articles
          UNION ALL SELECT 'included', count(*) FROM left_over_articles WHERE decision = 'include'
          UNION ALL SELECT 'excluded', count(*) FROM left_over_articles WHERE decision = 'exclude'
          UNION ALL SELECT 'uncertain', count(*) FROM left_over_articles WHERE decision = 'uncertain')""",
        SCREENED_CTE,
        "left_over_articles AS (SELECT * FROM screened WHERE entry_id NOT IN (SELECT dup_id FROM removed))",
    ),
)
def flow_counts(spark, sf_dir):
    articles = tables.articles(spark, sf_dir)
    result = dedup.deduplicate(articles)
    decisions = rules.rule_screen(result.unique, EXCLUSION, INCLUSION)
    return dedup.flow_counts(articles, result.pairs, decisions)


def flagship(spark, sf_dir) -> DataFrame:
    """After removing duplicates: how many articles are included, excluded, uncertain?"""
    articles = tables.articles(spark, sf_dir)
    unique = dedup.deduplicate(articles).unique
    return rules.decision_counts(rules.rule_screen(unique, EXCLUSION, INCLUSION))


query(
    "screen_unique",
    _with_pairs(
        """SELECT d.decision, count(s.entry_id) AS n
        FROM (SELECT unnest(['include', 'exclude', 'uncertain']) AS decision) d
        LEFT JOIN (SELECT * FROM screened WHERE entry_id NOT IN (SELECT dup_id FROM removed)) s USING (decision)
        GROUP BY ALL""",
        SCREENED_CTE,
    ),
)(flagship)


@query(
    "last_value_wins",
    with_articles(
        """SELECT title AS entry_id, min(ord) AS ord, arg_max(year, ord) AS year, arg_max(doi, ord) AS doi
        FROM articles GROUP BY title"""
    ),
)
def last_value_wins(spark, sf_dir):
    rows = tables.articles(spark, sf_dir).select(F.col("title").alias("entry_id"), "ord", "year", "doi")
    return exact.last_value_wins(rows)
