"""Text normalisation and word-set expressions (all plain column expressions)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character classes: a word character is a letter, a number or the underscore, and white space is the
# Unicode kind. Spelled out because the shorthand classes of the regex engines cover ASCII only. Plain letters come
# first because they are the quickest to test.
WORD = r"a-zA-Z\p{L}\p{N}_"
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\p{Z}"


def text(col: Column | str) -> Column:
    """The column as a string in which a missing value is the blank string."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def strip(col: Column | str) -> Column:
    return F.regexp_replace(text(col), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(col: Column | str) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text(col), f"[{SPACE}]+", " "))


def normalize_doi(doi: Column | str) -> Column:
    return strip(F.lower(text(doi)))


def normalize_title(title: Column | str) -> Column:
    """Lower case without punctuation: 'Non-Small  cell!' becomes 'nonsmall cell'."""
    return squeeze(F.regexp_replace(F.lower(text(title)), f"[^{WORD}{SPACE}]+", ""))


def clean_text(*parts: Column | str) -> Column:
    """The text classifiers see: the parts in order, punctuation turned into spaces, lower case."""
    joined = F.concat_ws(" ", *[text(p) for p in parts])
    return F.lower(F.trim(F.regexp_replace(joined, f"[^{WORD}]+", " ")))


def has_words(*parts: Column | str) -> Column:
    """Whether the cleaned text would not be blank; stops at the first word character."""
    return reduce(Column.__or__, [text(p).rlike(f"[{WORD}]") for p in parts])


def author_key(author: Column | str) -> Column:
    """Sorted lower-case last names of a 'Last, First and First Last' list."""

    def last_name(name: Column) -> Column:
        words = F.filter(F.split(name, f"[{SPACE}]+"), lambda w: w != "")
        last_word = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise("")
        return F.lower(F.when(name.contains(","), strip(F.substring_index(name, ",", 1))).otherwise(last_word))

    names = F.transform(F.split(text(author), " and "), last_name)
    return F.when(text(author) == "", "").otherwise(F.array_join(F.array_sort(names), " "))


def words(col: Column | str) -> Column:
    """Sorted distinct white-space separated words; an empty array for a blank string."""
    parts = F.filter(F.split(text(col), f"[{SPACE}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(parts))


def jaccard(left: Column, right: Column) -> Column:
    """Shared words over all words of two word sets, 0 when either is empty. The overlap is worked out once."""
    sizes = F.size(left) + F.size(right)
    shared = F.array(F.size(F.array_intersect(left, right)))
    share = F.transform(shared, lambda s: F.coalesce(F.try_divide(s, sizes - s), F.lit(0.0)))
    return F.get(share, F.lit(0))


def count_whole_word(col: Column | str, term: str) -> Column:
    """Case-insensitive occurrences of ``term`` that are not part of a longer word."""
    quoted = re.escape(term.lower())
    # the term comes first: what stands before it is looked at where it is found, not at every character
    pattern = f"(?:{quoted})(?<![{WORD}](?:{quoted}))(?![{WORD}])"
    return F.regexp_count(F.lower(text(col)), F.lit(pattern))
