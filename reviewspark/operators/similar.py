"""Near-duplicate pass: exact set-similarity join on titles and authors with order-dependent fates.

An article left over by the exact passes has no DOI and no year (or no usable title). It is compared with every
article kept so far, in order, and becomes a duplicate of the best match, a borderline case, or a new kept
article that later ones are compared with. The jobs below give the result of that sequential rule:

* Leftovers with equal title words and author words form one signature. Only its first article can be kept, so
  copies never meet each other; targets are collapsed the same way to their first article.
* Targets that differ only in words found nowhere else score alike, so only the first of them is compared.
* Candidates come from an equi-join on prefix words (Chaudhuri et al. 2006, Xiao et al. 2008): sets with Jaccard
  above t share a word among the first |x| - ceil(t|x|) + 1 of any common word order. Rare words come first. Each
  branch of the rule has its own title threshold and, where authors matter, the hash slot of an author's prefix word
  in the key. Index rows are narrow: a hashed key, the signature's number, the sizes, the word's position and 64 bits
  per word set. Sizes, positions and bits drop most pairs in the join; each pair that is left is fetched with its words
  and verified once.
* A word flips one of its set's 64 bits (Sandes et al. 2020), so two sets differ in at least as many words as in bits.
  That bounds the words they share from above, and no pair that matches is dropped.
* Pairs of a key that holds many rows on both sides are cut into a grid of tasks.
* Fates: an open signature that is a sure match of the first one of a key of its own only waits, so the members of a
  group of near copies meet its first one, not each other. The others are compared with what is before them and are
  kept if nothing matches; sure matches of newly kept ones are closed. What is open after that is settled along its
  connected matches (`fates`), in a number of rounds that does not grow with the length of chains.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import checkpoint
from . import fates, skew
from .exact import CONFIRMED

# The thresholds and reasons of the near-duplicate rule.
TITLE_HIGH, TITLE_MEDIUM = 0.8, 0.5
AUTHOR_LOOSE, AUTHOR_STRICT = 0.5, 0.7
SURE, POSSIBLE = 0.7, 0.5
REASON_YEAR = "High title similarity and year match"
REASON_AUTHOR = "Title and author similarity"
REASON_BOTH = "Author similarity and year match"
REVIEW = "Needs Review"

# Word frequencies are kept per hash bucket, so the table that orders words has a fixed size.
FREQUENCY_BUCKETS = 8192
AUTHOR_SLOTS = 32
ROWS_PER_TASK = 200_000
PAIRS_PER_TASK = 400_000_000
SIDE_PER_TASK = 20_000
SIGNATURE = ["title_words", "author_words"]
BITS = ("t_bits", "a_bits")


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("title_words", tx.words("title_n")).withColumn("author_words", tx.words("author_n"))


def rule(title: Column, author: Column, no_year: Column) -> tuple[Column, Column]:
    """Score and reason by title and author similarity, null where no branch applies.

    A leftover with title words has a blank year, so the years agree exactly when the target's is blank.
    """
    branches = [
        (no_year & (title > TITLE_HIGH), title, REASON_YEAR),
        (~no_year & (title > TITLE_HIGH) & (author > AUTHOR_LOOSE), (title + author) / 2, REASON_AUTHOR),
        (
            no_year & (title > TITLE_MEDIUM) & (title <= TITLE_HIGH) & (author > AUTHOR_STRICT),
            (title + author) / 2,
            REASON_BOTH,
        ),
    ]
    score = F.coalesce(*[F.when(test, value) for test, value, _ in branches])
    reason = F.coalesce(*[F.when(test, F.lit(text)) for test, _, text in branches])
    return score, reason


def _similarity(words: str) -> Column:
    return tx.jaccard(F.col(words), F.col(f"r_{words}"))


def match_above(least: float) -> Column:
    """The pair's (score, reason) in an array, empty unless it scores above ``least``. Each similarity is worked out
    once, the authors' one only when the titles are close enough for any branch."""

    def by_title(title: Column) -> Column:
        def matched(author: Column) -> Column:
            score, reason = rule(title, author, F.col("r_no_year"))
            return F.struct(score.alias("score"), reason.alias("reason"))

        return F.transform(F.array(_similarity("author_words")), matched)

    titles = F.filter(F.array(_similarity("title_words")), lambda title: title > TITLE_MEDIUM)
    return F.filter(F.flatten(F.transform(titles, by_title)), lambda m: m["score"] > least)


# -- candidate keys ------------------------------------------------------------------------------------


def _bucket(kind: str, word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), word), F.lit(FREQUENCY_BUCKETS)).cast("int")


def word_frequencies(*frames: DataFrame) -> Column:
    """Occurrences per word bucket over all signatures, as one constant array of fixed length."""
    counted = [
        df.select(F.explode(F.transform(words, lambda w, k=words: _bucket(k, w))).alias("bucket"))
        for df in frames
        for words in SIGNATURE
    ]
    rows = reduce(DataFrame.unionByName, counted).groupBy("bucket").count().collect()
    table = ["0"] * FREQUENCY_BUCKETS
    for row in rows:
        table[row["bucket"]] = str(row["count"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def _rare_first(words: str, frequencies: Column) -> Column:
    tagged = F.transform(words, lambda w: F.struct(F.get(frequencies, _bucket(words, w)).alias("f"), w.alias("w")))
    return F.transform(F.array_sort(tagged), lambda p: p["w"])


def _prefix(ordered: Column, tenths: int) -> Column:
    """The words of which a set must share one with any set of Jaccard at or above tenths/10."""
    size = F.size(ordered)
    needed = F.floor((size * tenths + 9) / 10).cast("int")
    return F.slice(ordered, 1, size - needed + 1)


# Branches of the rule: tag, tenths of the title threshold, tenths of the author threshold.
BRANCHES = {"year": (8, 0), "both": (5, 7), "author": (8, 5)}


def _index_rows(tag: str, titles: Column, authors: Column | None) -> Column:
    """Array of (key, at, title_tenths, author_tenths), one per title word of the prefix and author slot."""
    tenths, author_tenths = BRANCHES[tag]

    def row(word: Column, at: Column, slot: Column) -> Column:
        key = F.xxhash64(F.lit(tag), word, slot)
        columns = {"key": key, "at": at, "title_tenths": F.lit(tenths), "author_tenths": F.lit(author_tenths)}
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    if authors is None:
        return F.transform(titles, lambda t, at: row(t, at, F.lit(0).cast("bigint")))
    slots = F.array_distinct(F.transform(authors, lambda a: F.pmod(F.xxhash64(a), F.lit(AUTHOR_SLOTS))))
    return F.flatten(F.transform(titles, lambda t, at: F.transform(slots, lambda slot: row(t, at, slot))))


def _bits(words: str) -> Column:
    """64 bits of a word set: each word flips the bit of its hash."""
    flip = lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    return F.aggregate(words, F.lit(0).cast("bigint"), flip)


def with_bits(signatures: DataFrame) -> DataFrame:
    return signatures.withColumns({"t_bits": _bits("title_words"), "a_bits": _bits("author_words")})


def index_rows(signatures: DataFrame, frequencies: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """The candidate index: num, ord, sizes t and a, ``carried`` columns, and one row per key. At most `AUTHOR_SLOTS` rows per title word.

    ``no_year`` marks targets without a year; null marks both roles at once.
    """
    titles, authors = _rare_first("title_words", frequencies), _rare_first("author_words", frequencies)
    sizes = [F.size("title_words").alias("t"), F.size("author_words").alias("a")]
    ordered = signatures.select("num", "ord", "no_year", *carried, *sizes, titles.alias("_t"), authors.alias("_a"))
    high, medium = _prefix(F.col("_t"), 8), _prefix(F.col("_t"), 5)
    loose, strict = _prefix(F.col("_a"), 5), _prefix(F.col("_a"), 7)
    same_year = F.concat(_index_rows("year", high, None), _index_rows("both", medium, strict))
    other_year = _index_rows("author", high, loose)
    keys = (
        F.when(F.col("no_year").isNull(), F.concat(same_year, other_year))
        .when(F.col("no_year"), same_year)
        .otherwise(other_year)
    )
    return ordered.select("num", "ord", "t", "a", *carried, F.inline(keys))


def _as_target(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])


def _bits_allow(size: str, tenths: Column) -> Column:
    """Whether the bits of two sets leave room for a Jaccard similarity above ``tenths`` / 10."""
    both = F.col(size) + F.col(f"r_{size}")
    twice_shared = both - F.bit_count(F.col(f"{size}_bits").bitwiseXOR(F.col(f"r_{size}_bits")))
    return twice_shared * (tenths + 10) > both * tenths * 2


def _could_match() -> Column:
    """Whether two rows of a key can belong to a pair that passes the key's branch, by sizes, position and bits.

    Words at the positions ``at`` are the first shared ones in the row of a pair that counts; so no more words than are
    left from there can be shared.
    """

    def shares_enough(size: str, tenths: str) -> Column:
        enough = F.least(size, f"r_{size}") * 10 > F.greatest(size, f"r_{size}") * F.col(tenths)
        return (F.col(tenths) == 0) | (enough & _bits_allow(size, F.col(tenths)))

    left = F.least(F.col("t") - F.col("at"), F.col("r_t") - F.col("r_at"))
    title = left * (F.col("title_tenths") + 10) > (F.col("t") + F.col("r_t")) * F.col("title_tenths")
    return title & shares_enough("t", "title_tenths") & shares_enough("a", "author_tenths")


def candidates(left: DataFrame, right: DataFrame, hot: DataFrame | None, extra: Column | None = None) -> DataFrame:
    """Distinct pairs (num, r_num) of index rows that share a key and can match."""
    test = _could_match() if extra is None else extra & _could_match()
    met = skew.grid_join(left, _as_target(right), "key", hot, F.col("num"), F.col("r_num"), test)
    return met.select("num", "r_num").distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float = POSSIBLE) -> DataFrame:
    """The pairs that score above ``least``, with the columns of both signatures, score and reason."""
    met = pairs.join(left, "num").join(_as_target(right), "r_num")
    return met.select(*[c for c in met.columns if not c.endswith("_words")], F.inline(match_above(least)))


@dataclass
class Matcher:
    """Numbered signatures of leftovers and of targets, with their index."""

    sources: DataFrame
    targets: DataFrame
    source_index: DataFrame
    target_index: DataFrame

    def target_matches(self) -> DataFrame:
        hot = skew.crowded_pairs(self.source_index, self.target_index, "key", PAIRS_PER_TASK, SIDE_PER_TASK)
        return verified(candidates(self.source_index, self.target_index, hot), self.sources, self.targets)


def _without_year() -> Column:
    """Index rows of the branches for targets without a year, such as other leftovers."""
    return F.col("author_tenths") != BRANCHES["author"][1]


def _numbered(df: DataFrame) -> DataFrame:
    return checkpoint(df.withColumn("num", F.monotonically_increasing_id()))


# -- the pass ------------------------------------------------------------------------------------------


def leftover_signatures(leftovers: DataFrame) -> DataFrame:
    """One row per distinct (title words, author words) with its first article and number of articles."""
    return (
        leftovers.groupBy(*SIGNATURE)
        .agg(F.min(F.struct("ord", "entry_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select(*SIGNATURE, F.col("first.entry_id").alias("sid"), F.col("first.ord").alias("ord"), "n")
    )


def target_signatures(kept: DataFrame) -> DataFrame:
    """Kept articles of the exact passes, collapsed to the first one among those the rule cannot tell apart."""
    return (
        kept.filter(F.size("title_words") > 0)
        .withColumn("no_year", F.col("year") == "")
        .groupBy(*SIGNATURE, "no_year")
        .agg(F.min(F.struct("pass", "ord", "entry_id")).alias("first"))
        .select(
            *SIGNATURE,
            "no_year",
            F.col("first.entry_id").alias("sid"),
            F.col("first.pass").alias("pass"),
            F.col("first.ord").alias("ord"),
        )
    )


def _best(edges: DataFrame, by: str) -> DataFrame:
    """Highest score per ``by``, ties to the first in the order kept articles were found."""
    rank = F.struct((-F.col("score")).alias("neg"), F.col("r_pass").alias("pass"), F.col("r_ord").alias("ord"))
    match = F.struct(rank.alias("rank"), F.col("r_sid").alias("target"), "reason")
    return edges.groupBy(by).agg(F.min(match).alias("best"))


def _match_columns(best: Column) -> list[Column]:
    return [best["target"].alias("target"), (-best["rank"]["neg"]).alias("score"), best["reason"].alias("reason")]


def lone_words(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Per signature (``sid``) the words that occur in no other signature, for titles and for authors."""

    def words(column: str) -> DataFrame:
        return (
            sources.select("sid", F.explode(column).alias("word"))
            .unionByName(targets.select("sid", F.explode(column).alias("word")))
            .withColumn("column", F.lit(column))
        )

    once = (
        words(SIGNATURE[0])
        .unionByName(words(SIGNATURE[1]))
        .groupBy("column", "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid"))
        .filter(F.col("n") == 1)
    )
    lists = [F.collect_list(F.when(F.col("column") == c, F.col("word"))).alias(f"lone_{c}") for c in SIGNATURE]
    return once.groupBy("sid").agg(*lists)


def first_of_equal_targets(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets collapsed to the first one of those that score the same against every leftover.

    A word that occurs nowhere else can never be shared, so targets with the same other words and the same
    numbers of words are alike. Many near copies that differ in words of their own become a single target.
    """
    marked = targets.join(lone_words(sources, targets), "sid", "left")
    classes = []
    for c in SIGNATURE:
        lone = F.coalesce(f"lone_{c}", F.array().cast("array<string>"))
        marked = marked.withColumn(f"core_{c}", F.array_except(c, lone)).withColumn(f"size_{c}", F.size(c))
        classes += [f"core_{c}", f"size_{c}"]
    first = F.min(F.struct("pass", "ord", "sid", *SIGNATURE)).alias("first")
    return marked.groupBy(*classes, "no_year").agg(first).select("no_year", "first.*")


def match_signatures(leftovers: DataFrame, kept: DataFrame, every_target: bool = False) -> Matcher:
    sources = _numbered(leftover_signatures(leftovers))
    targets = target_signatures(kept)
    if not every_target:
        targets = first_of_equal_targets(sources, checkpoint(targets))
    targets = _numbered(targets)
    frequencies = word_frequencies(sources, targets)
    both_roles = sources.withColumn("no_year", F.lit(None).cast("boolean"))
    index = [checkpoint(index_rows(with_bits(df), frequencies, BITS)) for df in (both_roles, targets)]
    return Matcher(sources, targets, *index)


def _members(articles: DataFrame, signatures: DataFrame, by: list[str], member: str, sid: str) -> DataFrame:
    """(member, sid): every article with the signature it belongs to."""
    named = signatures.select(*[F.col(c) for c in by], F.col("sid").alias(sid)).distinct()
    return articles.select(F.col("entry_id").alias(member), *by).join(named, by).select(member, sid)


def fuzzy_match(leftovers: DataFrame, kept: DataFrame) -> DataFrame:
    """All matches above 0.5 between leftover articles and the kept articles of the exact passes.

    Signatures are matched; at the end every article of a signature gets the matches of its signature.
    """
    leftovers, kept = with_words(leftovers), with_words(kept)
    edges = match_signatures(leftovers, kept, every_target=True).target_matches()
    edges = edges.select("sid", "r_sid", "score", "reason")
    kept = kept.filter(F.size("title_words") > 0).withColumn("no_year", F.col("year") == "")
    left = _members(leftovers, leftover_signatures(leftovers), list(SIGNATURE), "entry_id", "sid")
    right = _members(kept, target_signatures(kept), [*SIGNATURE, "no_year"], "target_id", "r_sid")
    return edges.join(left, "sid").join(right, "r_sid").select("entry_id", "target_id", "score", "reason")


def best_match(leftovers: DataFrame, kept: DataFrame) -> DataFrame:
    """Best kept article of the exact passes for each leftover article that has one."""
    leftovers = with_words(leftovers)
    best = _best(match_signatures(leftovers, with_words(kept)).target_matches(), "sid")
    members = _members(leftovers, leftover_signatures(leftovers), list(SIGNATURE), "entry_id", "sid")
    found = best.select("sid", *_match_columns(F.col("best"))).withColumnRenamed("target", "target_id")
    return members.join(found, "sid").drop("sid")


def _kept_of_open(open_rows: DataFrame, index: DataFrame, sources: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The numbers among ``open_rows`` (num) that end up kept."""
    sources = sources.select("num", "ord", *SIGNATURE)
    alone = sources.withColumn("no_year", F.lit(True))
    earlier = F.col("r_ord") < F.col("ord")
    index = checkpoint(index.where(_without_year()).join(open_rows, "num", "left_semi"))

    def sure(pairs: DataFrame) -> DataFrame:
        return verified(pairs, sources, alone, SURE).select("num", "r_num", "ord")

    # members of a group meet the first one of a key only
    firsts = index.groupBy("key").agg(F.min(F.struct("ord", "num", "t", "t_bits")).alias("first"))
    firsts = firsts.select("key", *[F.col(f"first.{c}").alias(f"r_{c}") for c in ("ord", "num", "t", "t_bits")])
    stars = index.join(firsts, "key").where(earlier & _bits_allow("t", F.lit(5)))  # no branch takes titles below that
    stars = checkpoint(sure(stars.select("num", "r_num").distinct()))
    waiting = stars.select("num").distinct()
    free = index.join(waiting, "num", "left_anti")
    matched = checkpoint(sure(candidates(free, index, hot, earlier)).select("num").distinct())
    kept = checkpoint(open_rows.join(waiting, "num", "left_anti").join(matched, "num", "left_anti"))
    rest = open_rows.join(kept, "num", "left_anti")
    by_star = stars.join(kept.withColumnRenamed("num", "r_num"), "r_num", "left_semi").select("num").distinct()
    rest = checkpoint(rest.join(by_star, "num", "left_anti"))
    kept_index, rest_index = index.join(kept, "num", "left_semi"), index.join(rest, "num", "left_semi")
    closed = sure(candidates(rest_index, kept_index, hot, earlier)).select("num").distinct()
    rest = checkpoint(rest.join(closed, "num", "left_anti"))

    # what is open now waits for one another only
    rest_index = checkpoint(index.join(rest, "num", "left_semi"))
    edges = sure(candidates(rest_index, rest_index, hot, earlier))
    edges = checkpoint(edges.select(F.col("num").alias("item"), F.col("ord").alias("place"), F.col("r_num").alias("earlier")))
    if not edges.isEmpty():
        rest = rest.join(fates.gone(edges).withColumnRenamed("item", "num"), "num", "left_anti")
    return checkpoint(kept.unionByName(rest))


def near_duplicates(leftovers: DataFrame, kept: DataFrame) -> DataFrame:
    """Duplicate and borderline pairs of the near-duplicate pass.

    ``leftovers``: entry_id, ord, title_n, author_n of articles without DOI and year but with a title.
    ``kept``: entry_id, ord, pass, title_n, author_n, year of the survivors of the exact passes.
    """
    leftovers = with_words(leftovers)
    match = match_signatures(leftovers, with_words(kept))
    sources, index = match.sources, match.source_index
    first_best = checkpoint(_best(match.target_matches(), "sid"))

    beaten = first_best.filter(-F.col("best.rank.neg") > SURE)
    open_rows = checkpoint(sources.join(beaten, "sid", "left_anti").select("num"))
    hot = skew.crowded_pairs(index, index, "key", PAIRS_PER_TASK, SIDE_PER_TASK)
    kept_new = _kept_of_open(open_rows, index, sources, hot)
    as_targets = sources.join(kept_new, "num", "left_semi").withColumn("no_year", F.lit(True)).withColumn("pass", F.lit(3))
    # a signature of several articles also has later ones that meet what is kept after its first
    several = index.join(sources.where("n > 1").select("num", F.lit(True).alias("several")), "num", "left")
    later = (F.col("num") != F.col("r_num")) & ((F.col("r_ord") < F.col("ord")) | F.col("several"))
    kept_index = index.where(_without_year()).join(kept_new, "num", "left_semi")
    pairs = candidates(several.where(_without_year()), kept_index, hot, later)
    later_edges = checkpoint(verified(pairs, sources, as_targets.drop("n")))
    before = _best(later_edges.filter(F.col("r_ord") < F.col("ord")), "sid")
    best = before.unionByName(first_best).groupBy("sid").agg(F.min("best").alias("best"))
    signatures = checkpoint(sources.select("sid", "ord", "n", *SIGNATURE).join(best, "sid", "left"))

    score = -F.col("best.rank.neg")
    firsts = signatures.filter(score.isNotNull()).select(F.col("sid").alias("dup_id"), "best")
    pairs = firsts.unionByName(_copies(leftovers, signatures, later_edges))
    return pairs.select(
        F.col("best.target").alias("primary_id"),
        "dup_id",
        score.alias("confidence"),
        F.col("best.reason").alias("reason"),
        F.when(score > SURE, CONFIRMED).otherwise(REVIEW).alias("status"),
    )


def _copies(leftovers: DataFrame, signatures: DataFrame, later_edges: DataFrame) -> DataFrame:
    """Best match of every later article of a signature; all of them are duplicates.

    If the first article was kept it is the best match. Otherwise it is the first article's own match, or a
    better one kept between the two.
    """
    many = signatures.filter(F.col("n") > 1)
    sized = many.select(*SIGNATURE, "sid", F.col("ord").alias("first_ord"), "best", "n")
    sized = sized.withColumn("key", F.xxhash64(*SIGNATURE))
    hot = skew.crowded(sized, "key", "n", ROWS_PER_TASK)
    rows = leftovers.select("entry_id", "ord", *SIGNATURE).withColumn("key", F.xxhash64(*SIGNATURE))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"r_{c}") for c in SIGNATURE])
    members = skew.salted_join(
        rows,
        _as_target(sized).withColumnRenamed("r_key", "key"),
        "key",
        hot,
        F.col("entry_id"),
        "inner",
        same & (F.col("entry_id") != F.col("r_sid")),
    )
    first_kept = F.coalesce(-F.col("r_best.rank.neg") <= SURE, F.lit(True))
    itself = F.struct(
        F.struct(F.lit(-1.0).alias("neg"), F.lit(3).alias("pass"), F.col("r_first_ord").alias("ord")).alias("rank"),
        F.col("r_sid").alias("target"),
        F.lit(REASON_YEAR).alias("reason"),
    )
    start = F.when(first_kept, itself).otherwise(F.col("r_best"))
    members = members.select("entry_id", "ord", F.col("r_sid").alias("sid"), first_kept.alias("own"), start.alias("best"))

    steps = _improvements(many, later_edges)
    better = (
        members.filter(~F.col("own"))
        .join(steps, "sid")
        .filter(F.col("step.rank.ord") < F.col("ord"))
        .select("entry_id", F.col("step").alias("best"))
    )
    every = members.select("entry_id", "best").unionByName(better)
    return every.groupBy(F.col("entry_id").alias("dup_id")).agg(F.min("best").alias("best"))


def _improvements(many: DataFrame, later_edges: DataFrame) -> DataFrame:
    """Per signature whose first article is a duplicate: kept articles after it that beat all matches so far."""
    edges = later_edges.filter((F.col("n") > 1) & (F.col("r_ord") > F.col("ord"))).select(
        "sid",
        F.struct(
            F.struct(
                (-F.col("score")).alias("neg"), F.col("r_pass").alias("pass"), F.col("r_ord").alias("ord")
            ).alias("rank"),
            F.col("r_sid").alias("target"),
            "reason",
        ).alias("step"),
    )
    beaten = many.filter(-F.col("best.rank.neg") > SURE).select("sid", F.col("best.rank.neg").alias("first_neg"))
    edges = edges.distinct().join(beaten, "sid").filter(F.col("step.rank.neg") < F.col("first_neg"))
    so_far = Window.partitionBy("sid").orderBy("step.rank.ord").rowsBetween(Window.unboundedPreceding, -1)
    ranked = edges.withColumn("best_before", F.min("step.rank.neg").over(so_far))
    return ranked.filter(
        F.col("best_before").isNull() | (F.col("step.rank.neg") < F.col("best_before"))
    ).select("sid", "step")
