"""Phrase collocations by dynamic itemset counting.

Texts are cut into pieces at punctuation and line ends, and pieces into words; a phrase is a run of words inside a piece.
The corpus lies in `SHARDS` shards that are scanned in a cycle. Single words are counted from the first shard on. A longer
phrase becomes active as soon as both of its subphrases (without its last, without its first word) have reached the
threshold in what has been counted so far, in whichever shard the scan is, and is counted for exactly one full cycle from
there; so phrases of several lengths are counted in one scan, and each count is exact when its cycle is complete. Every
part of a frequent phrase is frequent, so no frequent phrase is left out.

What is active is a table of `SLOTS` bytes: the step from which the phrases of a hash slot are at the threshold. A phrase's
first step is the later one of its two parts' slots, so each scan knows which phrases to count without a join. Slots that
two phrases share only make a scan count more phrases than it must; counts stay exact, and the threshold is checked on them.
The table is the only thing that is broadcast, and the numbers of newly filled slots the only thing that is gathered; its
size does not depend on the input.

Counts travel without texts: per phrase a 64-bit hash with `CHECK_BITS` further bits of another one, by which phrases are
told apart (within one batch of texts by the 64 bits alone), and one document that holds it. The texts of the phrases that
reach the threshold are read from those documents at the end, so there is one row per frequent phrase and none per batch.

Scores come from exact decimal arithmetic. The best phrases of a language are picked in rounds over slices of about
`SLICE` candidates, so no task ranks a language.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count each time; of cuts with
equal scores the one after fewer words counts; ties of score and count go by the phrase's bytes; an empty table gives an
empty table; a very long text is cut like any other, in one piece of memory; only the text and language columns matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import chunks
from .common import saved, whole_text
from .words import hashes, mixed

SHARDS = 4
SLOTS = 1 << 23
SLICE = 50_000
BATCH_CHARS = 4 << 20
CHECK_BITS = 15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_CHECK_STEP = np.uint64(0x9E3779B185EBCA87)
_NEVER = 255  # a slot that no phrase has filled


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    ends = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
    return lower, ends, ends | np.isin(np.arange(256), [0x20, 0x09])


_LOWER, _ENDS, _BLANK = _byte_tables()


class Words:
    """The words of several texts: their hashes (with the language's), the number of their text and of their piece."""

    def __init__(self, texts: Sequence[str], langs: Sequence[str]):
        raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        blank = _BLANK[data]
        opens = ~blank & np.append(True, blank[:-1])
        closes = blank & np.append(False, ~blank[:-1])
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        self.text = np.searchsorted(np.cumsum(sizes), starts, side="right")
        salts = {lang: int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little") for lang in set(langs)}
        salt = np.array([salts[lang] for lang in langs], np.uint64)[self.text]
        self.hash = mixed(hashes(data, starts, ends) + salt) if len(starts) else np.zeros(0, np.uint64)
        # a text ends a piece, so pieces are numbered by the ends before a word
        self.piece = np.cumsum(_ENDS[data])[starts] if len(starts) else np.zeros(0, np.int64)
        # the words again, with one space after each
        self.data = np.where(blank, np.uint8(0x20), data)[~blank | closes]
        sizes = ends - starts + 1
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends + 1 - sizes

    def phrases(self, first: np.ndarray, length: int) -> pa.Array:
        """The phrases of ``length`` words that start at the words ``first``, joined by spaces."""
        starts = self.starts[first]
        sizes = self.ends[first + length - 1] - starts
        offsets = np.append(0, np.cumsum(sizes))
        data = self.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def runs(words: Words, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: (length, hash, check, whether it lies within a piece) of the runs that start at each word."""
    n = len(words.hash)
    other = mixed(words.hash + (words.ends - words.starts).astype(np.uint64)) if n else words.hash
    h, check, inside = words.hash, other, np.ones(n, bool)
    for length in range(1, longest + 1):
        if length > 1:
            n -= 1
            if n <= 0:
                return
            inside = inside[:-1] & (words.piece[:n] == words.piece[length - 1 :])
            h = mixed(h[:-1] * _STEP + words.hash[length - 1 :])
            check = check[:-1] * _CHECK_STEP + other[length - 1 :]
        yield length, h, (check >> np.uint64(64 - CHECK_BITS)).astype(np.int32), inside


def active_phrases(words: Words, since: np.ndarray, step: int, shards: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: (place of a first occurrence, hash, tag, count) of the phrases that count in this step."""
    slots = np.uint64(len(since) - 1)
    reached = None
    for length, h, check, inside in runs(words, longest):
        first_step = np.zeros(len(h), np.uint8) if reached is None else np.maximum(reached[:-1], reached[1:])
        on = np.flatnonzero(inside & (first_step != _NEVER) & (first_step <= step) & (step < first_step.astype(np.int64) + shards))
        if len(on):
            _, at, counts = np.unique(h[on], return_index=True, return_counts=True)
            at = on[at]
            tag = (check[at] << 16) | (first_step[at].astype(np.int32) * (longest + 1) + length)
            yield at, h[at].view(np.int64), tag, counts
        reached = since[(h & slots).astype(np.int64)]  # of the phrases of this length
        reached[~inside] = _NEVER


def _scan(shard: DataFrame, shared: Broadcast, step: int, shards: int, longest: int) -> DataFrame:
    """(hash, tag, doc, c) of one shard, per batch. ``shared``: the steps of all slots. A tag holds check bits, first step, length."""
    names = ["hash", "tag", "doc", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = shared.value
        for batch in batches:
            langs, texts, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for a, b in chunks(texts, BATCH_CHARS):
                words = Words(texts[a:b], langs[a:b])
                for at, hashed, tag, counts in active_phrases(words, since, step, shards, longest):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashed, tag, docs[a:b][words.text[at]], counts)], names)

    return shard.select("lang", "text", "doc").mapInArrow(run, "hash bigint, tag int, doc bigint, c bigint")


def _named(corpus: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, length, f) of ``found`` (hash, tag, doc, c), the texts read from the documents ``doc``."""
    found = found.groupBy("doc").agg(F.collect_list(F.struct("hash", "tag", "c")).alias("found"))
    met = corpus.join(found, "doc").select("lang", "text", *[F.col(f"found.{c}").alias(c) for c in ("hash", "tag", "c")])
    names = ["lang", "phrase", "length", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, BATCH_CHARS):
                hashed, tags, counts = (batch.column(k).slice(a, b - a).flatten().to_numpy() for k in (2, 3, 4))
                order = np.lexsort((tags, hashed))
                hashed, tags, counts = hashed[order], tags[order], counts[order]
                words, own = Words(texts[a:b], langs[a:b]), pa.array(langs[a:b], pa.string())
                for length, h, check, inside in runs(words, longest):
                    mine = np.flatnonzero((tags & 0xFFFF) % (longest + 1) == length)
                    if not len(mine):
                        continue
                    # each phrase that is looked for, at the first place where hash and check agree
                    on = np.flatnonzero(inside)
                    on = on[np.isin(h[on].view(np.int64), hashed[mine])]
                    have = np.rec.fromarrays([h[on].view(np.int64), check[on]], names="h,c")
                    look = np.rec.fromarrays([hashed[mine], tags[mine] >> 16], names="h,c")
                    keys, at = np.unique(have, return_index=True)
                    _, place, which = np.intersect1d(keys, look, assume_unique=True, return_indices=True)
                    at, which = on[at[place]], mine[which]
                    columns = [own.take(pa.array(words.text[at])), words.phrases(at, length), pa.array(np.full(len(at), length, np.int32)), pa.array(counts[which])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return met.mapInArrow(run, "lang string, phrase string, length int, f bigint")


def frequent_phrases(docs: DataFrame, threshold: int, longest: int, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, phrase, length, f, at least ``threshold`` each; totals: lang, n). ``docs``: lang, text."""
    if shards * longest >= _NEVER:
        raise ValueError("steps are kept in a byte: fewer shards or shorter phrases")
    spark = docs.sparkSession
    path = scratch_path(spark, "phrases-shards")
    numbered = docs.withColumn("doc", F.monotonically_increasing_id())
    numbered = numbered.withColumn("shard", F.pmod("doc", F.lit(shards)).cast("int"))
    numbered.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    corpus = spark.read.schema("lang string, text string, doc bigint, shard int").parquet(path)
    since = np.full(slots, _NEVER, np.uint8)
    slot = F.col("hash").bitwiseAND(slots - 1).cast("int").alias("slot")
    kind = F.col("tag").bitwiseAND(0xFFFF)
    length, first_step = kind % (longest + 1), F.floor(kind / (longest + 1))
    open_counts, found, step, news = None, [], 0, 0
    while step < news + shards:  # a phrase that became active at step `news` is complete one cycle later
        shared = spark.sparkContext.broadcast(since)
        merged = _scan(corpus.where(F.col("shard") == step % shards), shared, step, shards, longest)
        merged = merged if open_counts is None else open_counts.unionByName(merged)
        merged = saved(merged.groupBy("hash", "tag").agg(F.min("doc").alias("doc"), F.sum("c").alias("c")), "phrases-open")
        shared.destroy()
        frequent = merged.where(F.col("c") >= threshold)
        fresh = frequent.where(length < longest).select(slot).distinct().toArrow()["slot"].to_numpy()
        fresh = fresh[since[fresh] == _NEVER]
        step += 1
        if len(fresh):
            since[fresh] = step
            news = step
        found.append(frequent.where(first_step + shards == step))
        open_counts = merged.where(first_step + shards > step)

    named = _named(corpus, functools.reduce(DataFrame.unionByName, found), longest)
    totals = corpus.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^.,;:!?\x0A-\x0D\x20\x09]+"))).cast("bigint").alias("n"))
    return saved(named, "phrases-frequent"), saved(totals, "phrases-totals")


def _cut_scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, length, a, l, r, n, score) of phrases of two words or more, at their lowest-scoring cut."""
    several = phrases.where("length > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    cuts = several.select("lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = cuts.select("lang", "phrase", "length", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    met = met.withColumn("above", F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")).withColumn("below", whole("l") * whole("r"))
    met = met.withColumn("score", F.expr("above div below"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return met.groupBy("lang", "phrase", "length", "a", "n").agg(best.alias("best")).select("lang", "phrase", "length", "a", "best.l", "best.r", "n", "best.score")


def _absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of phrases that are nearly always part of one longer frequent phrase.

    A phrase inside a longer one is inside one that is a word longer and at least as frequent, so those are enough.
    """
    longer = phrases.where("length > 2").withColumn("words", F.split("phrase", " "))
    sides = F.array(*[F.array_join(F.slice("words", start, F.col("length") - 1), " ") for start in (1, 2)])
    most = longer.select("lang", "f", F.explode(sides).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("f") * percent).select("lang", "phrase")


def _first(rows: DataFrame, most: int, slice_rows: int) -> DataFrame:
    """The first ``most`` rows of each language with their rank, in rounds over slices."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    while (n := rows.count()) > 4 * slice_rows:
        slices = -(-n // slice_rows)
        inside = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*order)
        fewer = saved(rows.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most).drop("place"), "phrases-first")
        if fewer.count() > 0.8 * n:  # many languages: slices are down to a language's first rows
            rows = fewer
            break
        rows = fewer
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)


def collocations(
    docs: DataFrame, threshold: int = 100, longest: int = 5, most: int = 2000, absorbed_percent: int = 100,
    text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS, slots: int = SLOTS, slice_rows: int = SLICE,
) -> DataFrame:
    """Per language its ``most`` best phrases: lang, rank, phrase, a, l, r, n, score."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    phrases, totals = frequent_phrases(narrow, threshold, longest, shards, slots)
    several = phrases.where("length > 1")
    kept = _cut_scores(phrases, totals).join(_absorbed(several, absorbed_percent), ["lang", "phrase"], "left_anti")
    kept = saved(kept.select("lang", "phrase", "a", "l", "r", "n", "score"), "phrases-scored")
    return _first(kept, most, slice_rows).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
