"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import SPACE, WORD
from ..sources.tables import ARTICLES_SQL, SEED_LABELS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MEMBERS = {"a": 37, "b": 53, "c": 71}  # score of member m: ((doc_id * K) % 1000) / 1000


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def with_articles(select: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join([ARTICLES_SQL.strip(), *[c.strip() for c in ctes]])} {select}"


LABELS_CTE = SEED_LABELS_SQL

# -- SQL twins of the text expressions ---------------------------------------------------------------


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_doi(x: str) -> str:
    return sql_strip(f"lower({x})")


def sql_title(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower({x}), '[^{WORD}{SPACE}]', '', 'g')")


def sql_clean(x: str) -> str:
    return f"lower({sql_squeeze(f"regexp_replace({x}, '[^{WORD}{SPACE}]', ' ', 'g')")})"


CLEAN = sql_clean("title || ' ' || abstract || ' ' || keywords")


def sql_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def sql_words(x: str) -> str:
    return f"list_sort(list_distinct({sql_split(x)}))"


def sql_author_key(x: str) -> str:
    last = f"coalesce({sql_split('n')}[-1], '')"
    name = f"lower(CASE WHEN contains(n, ',') THEN {sql_strip("split_part(n, ',', 1)")} ELSE {last} END)"
    return (
        f"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_sort(list_transform(string_split({x}, ' and '), "
        f"lambda n: {name})), ' ') END"
    )


def sql_jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END)"
