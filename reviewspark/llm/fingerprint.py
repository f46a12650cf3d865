"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces, in SQL functions only.

A text is cut into sections (a section starts at a blank line or at a heading line), sections into paragraphs (lines) and
paragraphs into pieces of up to four words (of 64 characters at most) that end with a sentence. A paragraph's hash is SHA-256 of its text, a
section's that of its paragraphs' hashes, the root that of the sections' hashes; so equal roots mean equal texts, and two
trees differ only below branches whose hashes differ. Pieces carry 24 hash bits and their length; they locate an edit
inside a paragraph and give the likeness of two trees: twice the length of the pieces they share over the sum of both
lengths, once over distinct pieces and once over pieces in the same place, whichever is larger (1 for equal roots). One edit would
change all pieces of a short text, so texts of at most `PLACED` code points also have a leaf per code point and place. Two
such texts are compared by those if either has at most `SHORT` of them, all others by their pieces; so both trees of a
comparison always give the same kind of leaves.

The fingerprint is one string: root, then per section `|hash`, per paragraph `/hash`, per piece `,hex`, per placed code point
`;hex`.

`with_next` joins every document to the next one by id in one shuffle: quantiles of the ids give ranges, a document goes to
its range, and the first document of a range also goes to the range before as a guest. The quantiles (four per shuffle
partition, like the bounds of a range sort) are the only thing gathered; they stay in a subquery.

Defined results: null is the empty text (root of no sections' text, no pieces; likeness 1 to itself, 0 to others); repeated
ids follow one another by text; a null id comes first; a table of one row is followed by itself; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SHORT = 64
PLACED = 2 * SHORT
PIECE = r"\s*(?:\S{0,63}[^\s.!?]\s+){0,3}\S{1,64}\s*"
SECTION = r"(?<=\n)(?=[ \t\r]*\n|#)"
BUCKETS_PER_PARTITION = 4


def _digest(x: Column, digits: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def _piece(x: Column, salt: Column | None = None) -> Column:
    """24 hash bits and the length (up to 255) in one number."""
    h = F.xxhash64(x) if salt is None else F.xxhash64(x, salt)
    return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFF)), 8).bitwiseOR(F.least(F.char_length(x), F.lit(255)).cast("bigint"))


def tree(text: Column) -> Column:
    """array of sections: (hash, paragraphs: array of (hash, pieces: array<bigint>, places: array<bigint>))."""
    placed = F.char_length(text) <= PLACED

    def pieces(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), 0), lambda p: _piece(p))

    def places(paragraph: Column) -> Column:
        return F.when(placed, F.transform(F.split(paragraph, ""), lambda p, i: _piece(p, i))).otherwise(F.array().cast("array<bigint>"))

    def section(part: Column) -> Column:
        paragraphs = F.transform(F.split(part, "\n"), lambda p: F.struct(F.sha2(p, 256).alias("hash"), pieces(p).alias("pieces"), places(p).alias("places")))
        joined = F.array_join(F.transform(paragraphs, lambda p: p["hash"]), "")
        return F.struct(F.sha2(joined, 256).alias("hash"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, SECTION), section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)


def encoded(sections: Column) -> Column:
    """The fingerprint string of a tree."""
    listed = lambda xs, mark: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(mark), F.hex(x))), "")
    paragraph = lambda p: F.concat(F.lit("/"), F.substring(p["hash"], 1, 12), listed(p["pieces"], ","), listed(p["places"], ";"))
    section = lambda s: F.concat(F.lit("|"), F.substring(s["hash"], 1, 16), F.array_join(F.transform(s["paragraphs"], paragraph), ""))
    return F.concat(root(sections), F.array_join(F.transform(sections, section), ""))


def leaves(sections: Column) -> Column:
    """All pieces and all placed code points of a tree, in order: (pieces, places)."""
    every = lambda kind: F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p[kind]))))
    return F.struct(every("pieces").alias("pieces"), every("places").alias("places"))


def decoded_leaves(fingerprint: Column) -> Column:
    """The same from the fingerprint string."""
    every = lambda mark: F.transform(F.regexp_extract_all(fingerprint, F.lit(f"{mark}([0-9A-F]+)"), 1), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.struct(every(",").alias("pieces"), every(";").alias("places"))


def _weight(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda n, x: n + x.bitwiseAND(F.lit(255)))


def _dice(shared: Column, a: Column, b: Column) -> Column:
    both = (_weight(a) + _weight(b)).cast("double")
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * _weight(shared) / both)


def _alike(a: Column, b: Column) -> Column:
    in_place = F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(0).cast("bigint")))
    distinct = _dice(F.array_intersect(a, b), F.array_distinct(a), F.array_distinct(b))
    return F.greatest(distinct, _dice(in_place, a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of the leaves of two trees; ``same``: the roots are equal."""
    sizes = F.size(a["places"]), F.size(b["places"])  # 0 for texts beyond PLACED; the empty text has one empty place
    by_place = (F.least(*sizes) > 0) & (F.least(*sizes) <= SHORT)
    return F.when(same, F.lit(1.0)).when(by_place, _alike(a["places"], b["places"])).otherwise(_alike(a["pieces"], b["pieces"]))


def compare(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings."""
    return likeness(decoded_leaves(a), decoded_leaves(b), F.substring(a, 1, 64) == F.substring(b, 1, 64))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of fingerprint ``a`` that ``b`` does not have: where the texts differ.

    The line break that ends a section counts as an empty paragraph.
    """
    hashes = lambda x: F.regexp_extract_all(x, F.lit("/([0-9a-f]{12})"), 1)
    numbered = F.transform(hashes(a), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    return F.transform(F.filter(numbered, lambda x: ~F.array_contains(hashes(b), x["hash"])), lambda x: x["place"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint. One narrow pass."""
    return docs.select(id_col, encoded(tree(whole_text(text_col))).alias("fingerprint"))


def _range_of(key: Column, bounds: Column) -> Column:
    """Number of the range of a key: the last bound that is not above it, by binary search."""
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        below = F.element_at(bounds, middle + 1) <= key
        open_ = s["high"] - s["low"] > 1
        return F.struct(F.when(open_ & below, middle).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, halve, lambda s: s["low"])


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents by id range (``range_no``), each range followed by the first document of the next (``guest`` > 0)."""
    spark = docs.sparkSession
    ranges = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    keys = docs.select(key.alias("key"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    quantiles = keys.agg(F.array_sort(F.array_distinct(F.concat(F.array(F.min("key")), F.percentile_approx("key", shares, 10 * ranges)))).alias("bounds"))
    with_bounds = docs.select(F.col(id_col), key.alias("key"), whole_text(text_col).alias("text"), quantiles.scalar().alias("bounds"))
    place = _range_of(F.col("key"), F.col("bounds"))
    placed = with_bounds.select(id_col, "key", "text", place.alias("at"), F.size("bounds").alias("n"), (F.element_at("bounds", place + 1) == F.col("key")).alias("is_bound"))
    own = F.struct(F.col("at").alias("range_no"), F.lit(0).alias("guest"))
    before = F.struct((F.col("at") - 1).alias("range_no"), F.lit(1).alias("guest"))
    around = F.struct((F.col("n") - 1).alias("range_no"), F.lit(2).alias("guest"))  # after the last document comes the first
    seats = F.when(~F.col("is_bound"), F.array(own)).when(F.col("at") == 0, F.array(own, around)).otherwise(F.array(own, before))
    seated = placed.withColumn("seat", F.explode(seats))
    return seated.select(id_col, "key", "text", F.col("seat.range_no").alias("range_no"), F.col("seat.guest").alias("guest"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, the one of its edited text, and the likenesses (see `queries.merkle_fingerprints`)."""
    spark = docs.sparkSession
    ranges = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(docs, id_col, text_col).repartition(ranges, "range_no")
    trees = dealt.withColumn("sections", tree(F.col("text")))
    trees = trees.select(id_col, "key", "text", "range_no", "guest", root(F.col("sections")).alias("root"), encoded(F.col("sections")).alias("fingerprint"), leaves(F.col("sections")).alias("leaves"))
    following = Window.partitionBy("range_no").orderBy("guest", "key", "text")
    pairs = trees.select(
        id_col, "guest", "text", "root", "fingerprint", "leaves", F.lead("text").over(following).alias("next_text"),
        F.lead("root").over(following).alias("next_root"), F.lead("leaves").over(following).alias("next_leaves"),
    ).where("guest = 0")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - quarter)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), quarter))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_sections", tree(F.col("edited")))
    pairs = pairs.withColumn("edited_root", root(F.col("edited_sections"))).withColumn("edited_leaves", leaves(F.col("edited_sections")))
    return pairs.select(
        id_col, F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        encoded(F.col("edited_sections")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves"), F.col("root") == F.col("edited_root")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves"), F.col("root") == F.col("next_root")).alias("near_next"),
    )
