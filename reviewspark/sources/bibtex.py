"""Bulk scan and export of BibTeX files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions import text as tx
from ..schema import position, to_articles
from ..session import checkpoint

FILE_SUFFIX = "_results.bib"

# Month abbreviations that may stand without quotes.
MONTHS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June",
    "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}

ENTRY_START = re.compile(r"@?\s*(\w+)\s*([{(])")
# a line that opens an entry: its kind and a key followed by a field or the end; a line of a value may start with '@' too
OPENS = re.compile(
    r"@?\s*(?:(?:comment|preamble|string)\s*[{(]|\w+\s*[{(][^{}(),=\"]*,\s*[^\s{}(),=\"#]+\s*=|\w+\{[^\s{}(),=\"]+\s*,?\s*\}\s*(?:\n|$))",
    re.I,
)
DEFINES = re.compile(r"@?\s*string\s*[{(]", re.I)
GROUPING = re.compile(r'[{}()"]')
SCANNED = (
    "file string, block bigint, pos bigint, entry_type string, entry_key string, fields map<string,string>"
)
# entry fields with a column of their own, and that column's name
COLUMNS = {
    "title": "title", "abstract": "abstract", "journal": "journal", "year": "year", "volume": "volume",
    "number": "issue", "issue": "issue", "pages": "pages", "doi": "doi", "url": "url", "author": "author",
    "pmid": "pmid", "scopus_id": "scopus_id", "eid": "eid", "embase_id": "embase_id", "source_id": "source_id",
    "citation_count": "citation_count", "document_type": "document_type", "pii": "pii", "lui": "lui", "medline": "medline",
    "language": "language", "species": "species", "subject_area": "subject_area", "evidence_type": "evidence_type",
}


MARK = "\0"  # around the name of a macro inside a parsed value
STRETCH = 1 << 16  # places per stretch of a file block


def _close(text: str, start: int, opener: str) -> int:
    """Index of the character that closes the group opened before ``start``, or -1 when the text ends first."""
    closer = {"{": "}", "(": ")", '"': '"'}[opener]
    depth = 0
    for match in GROUPING.finditer(text, start):
        ch, i = match[0], match.start()
        if depth == 0 and ch == closer and (i == 0 or text[i - 1] != "\\" or closer != '"'):
            return i
        if ch == "{":
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
    return -1


def _fields(body: str) -> dict[str, str]:
    """name = value pairs; values are braced, quoted or bare and may be joined with #. Names of macros are marked."""
    found, i = {}, 0
    while match := re.compile(r"[\s,]*([^\s,={}\"#]+)\s*=").match(body, i):
        name, i, parts = match.group(1).lower(), match.end(), []
        while True:
            i += len(body[i:]) - len(body[i:].lstrip())
            if i < len(body) and body[i] in '{"':
                end = _close(body, i + 1, body[i])
                end = len(body) if end < 0 else end
                parts.append(body[i + 1 : end].replace(MARK, "\ufffd"))
                i = end + 1
            else:
                bare = re.compile(r"[^\s,#]*").match(body, i)
                word = MONTHS.get(bare.group().lower())
                if word is None:
                    word = bare.group() if re.fullmatch(r"\d*", bare.group()) else f"{MARK}{bare.group()}{MARK}"
                parts.append(word)
                i = bare.end()
            more = re.compile(r"\s*#").match(body, i)
            if not more:
                break
            i = more.end()
        found[name] = " ".join("".join(parts).split())
    return found


def parse_entries(text: str) -> tuple[list[tuple[str, str, dict[str, str]]], str]:
    """Complete entries of a text, definitions of macros (type string) included, and the text of a last one that is open."""
    entries, i = [], len(text) - len(text.lstrip())
    while True:
        match = ENTRY_START.match(text, i)
        if not match:
            i = text.find("@", i + 1)
            if i < 0:
                return entries, ""
            continue
        end = _close(text, match.end(), match.group(2))
        if end < 0:
            return entries, text[match.start() :]
        kind, body = match.group(1).lower(), text[match.end() : end]
        if kind == "string":
            entries.append((kind, "", _fields(body)))
        elif kind not in ("comment", "preamble"):
            key, _, rest = body.partition(",")
            entries.append((kind, key.strip(), _fields(rest)))
        i = text.find("@", end + 1)
        if i < 0:
            return entries, ""


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str, bool]]:
    """(file, block, text, opens an entry) of each stretch of a file block that starts with an entry, in order.

    The lines before the first entry of a block come first, as a stretch that opens none; every block has that stretch.
    """
    where, lines, opens = None, [], False
    for batch in batches:
        for value, file, block in zip(batch["value"], batch["file"], batch["block"]):
            if (file, block) != where:
                if where:
                    yield *where, "\n@".join(lines), opens
                where, lines, opens = (file, block), [], False
            if OPENS.match(value):
                yield *where, "\n@".join(lines), opens
                lines, opens = [], True
            lines.append(value)
    if where:
        yield *where, "\n@".join(lines), opens


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries that end inside their file block. What is still open when the next entry opens is broken: type '!'."""
    rows, where, held, stretch = [], None, None, 0
    for file, block, text, opens in _blocks(batches):
        if (file, block) != where:
            where, held, stretch = (file, block), None, 0
        if held:  # the entry before has ended, since another one opens
            rows.append((file, block, held[0], "!", held[1][:80], {}))
            held = None
        if opens:
            entries, rest = parse_entries(text)
            places = range(stretch, stretch + STRETCH)
            rows.extend((file, block, at, *entry) for at, entry in zip(places, entries) if entry[0] != "string")
            held = (stretch + len(entries), rest) if rest else None
            stretch += STRETCH
        if len(rows) >= 1000:
            yield pd.DataFrame(rows, columns=PARSED)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=PARSED)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per file block: the lines before its first entry, whether one opens, its macros, and its last entry if that is open.

    Only the last stretch and those that define macros are parsed.
    """
    where, row, last, stretch = None, None, None, 0

    def finished() -> pd.DataFrame:
        entries, held = parse_entries(last) if last is not None else ([], "")
        macros = [*row[4], *_definitions(entries, stretch - STRETCH)]
        return pd.DataFrame([(*row[:4], macros, held, stretch - STRETCH + len(entries))], columns=EDGES)

    for file, block, text, opens in _blocks(batches):
        if (file, block) != where:
            if row:
                yield finished()
            where, row, last, stretch = (file, block), (file, block, text, False, []), None, 0
        if opens:
            if last is not None and DEFINES.match(last):
                row[4].extend(_definitions(parse_entries(last)[0], stretch - STRETCH))
            row, last, stretch = (*row[:3], True, row[4]), text, stretch + STRETCH
    if row:
        yield finished()


def _definitions(entries: list[tuple[str, str, dict[str, str]]], at: int) -> list[tuple[int, str, str]]:
    return [(at + k, name, value) for k, (kind, _, fields) in enumerate(entries) if kind == "string" for name, value in fields.items()]


def _filled(value: str, macros: Mapping[str, str]) -> str:
    """A value with its marked macros; the name stands where there is none."""
    parts = value.split(MARK)
    parts[1::2] = [macros.get(name.lower(), name) for name in parts[1::2]]
    return "".join(parts)


def _stitch(edges: pd.DataFrame) -> pd.DataFrame:
    """Entries of one file that run on into later blocks, and the file's macros in their order, filled in."""
    rows, macros, carry = [], [], None

    def finish() -> None:
        file, block, pos, text = carry
        entries, held = parse_entries(text)
        macros.extend((block, *m) for m in _definitions(entries, pos))
        found = [(file, block, pos + k, *entry) for k, entry in enumerate(entries) if entry[0] != "string"]
        rows.extend(found if not held else [(file, block, pos, "!", held[:80], {})])

    for file, block, head, opens, found, tail, pos in edges.sort_values("block")[EDGES].itertuples(index=False):
        macros.extend((block, m["pos"], m["name"], m["value"]) for m in found)
        if carry and head:
            carry = (*carry[:3], f"{carry[3]}\n@{head}")
        if opens:
            if carry:
                finish()
            carry = (file, block, pos, tail) if tail else None
    if carry:
        finish()
    known: dict[str, str] = {}
    for block, pos, name, value in sorted(macros):
        known[name] = _filled(value, known)
        rows.append((file, block, pos, "string", name, {"value": known[name]}))
    return pd.DataFrame(rows, columns=PARSED)


PARSED = ["file", "block", "pos", "entry_type", "entry_key", "fields"]
EDGES = ["file", "block", "head", "opens", "macros", "tail", "pos"]
EDGE_TYPES = (
    "file string, block bigint, head string, opens boolean, macros array<struct<pos:bigint,name:string,value:string>>, "
    "tail string, pos bigint"
)


def _with_macros(entries: DataFrame, macros: DataFrame) -> DataFrame:
    """Values with their macros filled in: of the definitions of the entry's file, the last one before the entry counts."""
    if macros.isEmpty():
        listed = entries.withColumn("macros", F.lit(None).cast("array<struct<block:bigint,pos:bigint,name:string,value:string>>"))
    else:
        each = F.struct("block", "pos", F.lower("entry_key").alias("name"), F.col("fields")["value"].alias("value"))
        lists = macros.groupBy("file").agg(F.sort_array(F.collect_list(each)).alias("macros"))  # a file's definitions
        listed = entries.join(lists, "file", "left")

    def part(text: Column, at: Column) -> Column:
        own = lambda m: (m["name"] == F.lower(text)) & (F.struct(m["block"], m["pos"]) < F.struct(F.col("block"), F.col("pos")))
        defined = F.try_element_at(F.filter("macros", own), F.lit(-1))["value"]
        return F.when(at % 2 == 1, F.coalesce(defined, text)).otherwise(text)

    def filled(_: Column, value: Column) -> Column:
        return F.when(value.contains(MARK), F.array_join(F.transform(F.split(value, "\\x00"), part), "")).otherwise(value)

    return listed.withColumn("fields", F.transform_values("fields", filled)).drop("macros")


def people(author: Column | str) -> Column:
    """Last and first names of a 'Last, First and First Last' text."""

    def one(name: Column) -> Column:
        words = F.filter(F.split(name, f"[{tx.SPACE}]+"), lambda w: w != "")
        comma = name.contains(",")
        last = F.when(comma, tx.strip(F.substring_index(name, ",", 1))).otherwise(F.element_at(words, -1))
        first = F.when(comma, tx.strip(F.substring_index(name, ",", -1))).otherwise(
            F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
        )
        return records.person(last, first, F.lit(""))

    names = F.filter(F.split(tx.text(author), " and "), lambda n: tx.strip(n) != "")
    return F.transform(names, one)


def scan_bibtex(spark: SparkSession, path: str, prefix_keys: bool = True, skip_broken: bool = False) -> DataFrame:
    """Articles of all BibTeX files under ``path``; the source is the file name without its suffix.

    Every entry is one record of a splittable text scan, and the entries do not depend on where files are split. With
    ``prefix_keys`` ids are 'source_key'. An entry that is not closed before the next one opens is an error that names its
    file, or with ``skip_broken`` left out. Macros (@string, also joined ones) are filled in wherever the file is split, the
    last definition before the entry; a name without definition stands for itself. The blocks' ends and the macros are
    gathered when the scan is set up, in a first pass that parses little else.
    """
    lines = (
        spark.read.option("lineSep", "\n@")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    # a small row per file block meets the others of its file; an entry may be cut by any number of block ends
    edges = lines.mapInPandas(_edges, EDGE_TYPES)
    stitched = checkpoint(edges.groupBy("file").applyInPandas(_stitch, SCANNED))
    macro = F.col("entry_type") == "string"
    scanned = _with_macros(lines.mapInPandas(_scan, SCANNED).union(stitched.filter(~macro)), stitched.filter(macro))
    broken = F.col("entry_type") == "!"
    if skip_broken:
        scanned = scanned.filter(~broken)
    else:
        problem = F.concat(F.lit("an entry is not closed in "), "file", F.lit(", block at byte "), F.col("block").cast("string"), F.lit(": "), "entry_key")
        scanned = scanned.withColumn("entry_type", F.when(broken, F.raise_error(problem)).otherwise(F.col("entry_type")))
    name = F.element_at(F.split("file", "/"), -1)
    source = F.replace(F.url_decode(name), F.lit(FILE_SUFFIX), F.lit(""))
    scanned = scanned.withColumn("source", source)
    field = lambda n: F.col("fields")[n]
    columns: dict[str, Column] = {}
    for bib, column in COLUMNS.items():
        columns[column] = F.coalesce(columns[column], field(bib)) if column in columns else field(bib)
    known = [*COLUMNS, "keywords", "publication_type"]
    lists = {n: F.filter(F.split(tx.text(field(n)), ", "), lambda k: k != "") for n in ("keywords", "publication_type")}
    return to_articles(
        scanned,
        F.col("source"),
        position(F.col("source"), F.col("file"), F.col("block"), F.col("pos")),
        F.concat("source", F.lit("_"), "entry_key") if prefix_keys else F.col("entry_key"),
        entry_type=F.col("entry_type"),
        authors=people(field("author")),
        extra=F.map_filter("fields", lambda k, _: ~k.isin(known)),
        **columns,
        **lists,
    )


def bibtex_entry(entry_type: Column, key: Column, fields: Mapping[str, Column], more: Column | None = None) -> Column:
    """Text of one entry; blank fields are left out. Braces that do not pair up are removed from values.

    ``more``: a map of further fields, written after the others by name.
    """

    def line(name: str | Column, value: Column) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        value = tx.text(value)
        opened, closed = F.regexp_count(value, F.lit(r"\{")), F.regexp_count(value, F.lit(r"\}"))
        paired = (opened == closed) & ~value.rlike(r"^[^{]*\}")
        safe = F.when(paired, value).otherwise(F.regexp_replace(value, "[{}]", ""))
        return F.when(value != "", F.concat(F.lit("    "), name, F.lit(" = {"), safe, F.lit("}")))

    lines = F.array(*[line(n, v) for n, v in fields.items()])
    if more is not None:
        listed = F.array_sort(F.map_entries(F.coalesce(more, F.create_map().cast("map<string,string>"))))
        lines = F.concat(lines, F.transform(listed, lambda e: line(e["key"], e["value"])))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))


def entry_text(articles: DataFrame, key: Column) -> Column:
    """The BibTeX entry of every article of a table, with all its fields."""
    keywords = F.col("keywords_str") if "keywords_str" in articles.columns else F.col("keywords")
    values = {bib: F.col(column) for bib, column in COLUMNS.items() if bib != "issue" and column in articles.columns}
    if "pubmed_id" in articles.columns:  # the same number under the name another database uses
        own = F.nullif(tx.text("pmid"), F.lit("")) if "pmid" in articles.columns else F.lit(None)
        values["pmid"] = F.coalesce(own, F.col("pubmed_id"))
    values["keywords"] = keywords
    if "publication_type" in articles.columns:
        values["publication_type"] = F.array_join("publication_type", ", ")
    more = F.map_filter("extra", lambda k, _: ~k.isin(*values)) if "extra" in articles.columns else None
    return bibtex_entry(F.col("entry_type"), key, values, more)


def original_key() -> Column:
    """The key an entry had in its own file: its id without the source in front."""
    prefixed = F.startswith(F.col("entry_id"), F.concat("source", F.lit("_")))
    return F.when(prefixed, records.strip_source_prefix("entry_id", "source")).otherwise(F.col("entry_id"))


def write_bibtex(articles: DataFrame, path: str, key: Column | str = "entry_id", mode: str = "overwrite") -> None:
    """Articles as BibTeX text files, one part per task. ``key``: `original_key()` gives back the keys of the files read."""
    key = F.col(key) if isinstance(key, str) else key
    articles.select(entry_text(articles, key).alias("value")).write.mode(mode).text(path)
