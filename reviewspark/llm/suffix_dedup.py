"""Removal of repeated byte strings: every byte covered by a string of `length` bytes that also starts anywhere else.

Two places can only start the same string of `length` bytes if their smallest hash of a quarter-length window inside that
string is the same (their anchor). So the corpus is cut, in one narrow pass, into segments: stretches of starting places with
one anchor. Anchors that occur once are done with; the rest is small, and only it is sorted:

* Segments that are equal as a whole repeat as a whole; they are counted, whatever their number, and one stays as a witness.
* Different segments of one anchor go to shards, which are filled by the anchors' sizes: none holds more than `shard_bytes`. A
  shard orders all suffixes of its segments by external induced sorting and gets the common prefix of neighbours with it
  (`induced`); a start whose common prefix with a neighbour reaches `length` is repeated. The queues of the sort go to disk
  beyond a fixed budget, and its order is used symbol by symbol.
* An anchor with more than `shard_bytes` of different segments would not fit a shard; its windows are counted one by one by
  hash, spread over all tasks. Nothing is dropped.

Equal texts are one class with a count from the start. Documents meet their runs of repeated starts by id, so a group of
copies is spread like other documents.

Defined results: null and empty texts have nothing to remove; texts shorter than `length` bytes keep everything; two equal
texts of at least `length` bytes lose everything; repeated rows are documents of their own (so they lose everything too); an
empty table gives an empty table; other columns do not matter. Strings are judged on the input, overlaps included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import induced
from .common import saved, whole_text
from .words import hashes, inverse_powers, mixed, powers

SHARD_BYTES = 8 << 20
_ROWS = 256  # rows of a batch that Python holds at once
_CODES = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash for every window of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    p = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * p[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * inverse_powers(n)[: n - width + 1])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start + 1, anchor occurs again inside, hash of the segment's bytes) of one text."""
    width = max(1, length // 4)
    h = window_hashes(data, width)
    reach = length - width + 1
    if len(h) < reach:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, bool), empty
    least = sliding_minimum(h, reach)
    lows = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    highs = np.append(lows[1:], len(least))
    anchors = least[lows]
    twice = np.fromiter((np.count_nonzero(h[a : b + reach - 1] == x) > 1 for a, b, x in zip(lows.tolist(), highs.tolist(), anchors, strict=True)), bool, len(lows))
    whole = hashes(data, lows, highs + length - 1)
    return anchors.view(np.int64), lows, highs, twice, whole.view(np.int64)


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _classes(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; classes: key, id, copies, n_bytes, parts: the segments)."""
    kind = docs.schema["id"].dataType.simpleString()
    part = "struct<anchor:bigint,low:int,high:int,twice:boolean,whole:bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            sizes, columns, counts = [], [[], [], [], [], []], []
            for text in batch.column(2).to_pylist():
                data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                found = segments(data, length)
                sizes.append(len(data))
                counts.append(len(found[0]))
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            flat = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)]
            parts = pa.StructArray.from_arrays(flat, ["anchor", "low", "high", "twice", "whole"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], ["id", "key", "n_bytes", "parts"])

    rows = saved(docs.select("id", "key", "text").mapInArrow(run, f"id {kind}, key string, n_bytes bigint, parts array<{part}>"), "suffix-rows")
    classes = rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("n_bytes").alias("n_bytes"), F.first("parts").alias("parts"))
    return rows.select("id", "key"), saved(classes, "suffix-classes")


def _repeated_starts(text: np.ndarray, starts: np.ndarray, lows: np.ndarray, highs: np.ndarray, length: int) -> list[tuple[list[int], list[int]]]:
    """Per segment (at ``starts`` in the shard's text) its runs of repeated starts, as offsets."""
    again = np.zeros(len(text), bool)
    for order, prefixes in induced.suffix_runs(text, length):
        hit = np.flatnonzero(prefixes >= length)
        again[order[hit]] = True
        again[order[hit - 1]] = True
    out = []
    for at, low, high in zip(starts.tolist(), lows.tolist(), highs.tolist(), strict=True):
        flags = np.concatenate([[False], again[at : at + high - low], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        out.append((edges[0::2].tolist(), edges[1::2].tolist()))
    return out


_RUNS = "anchor bigint, whole bigint, starts array<int>, stops array<int>"


def _dealt(sizes: DataFrame, shard_bytes: int) -> DataFrame:
    """Adds slice and shard to anchors of at most ``shard_bytes`` each: no (slice, shard) holds more than that.

    Anchors of over half a shard are alone. The others are laid end to end within slices of some eight shards, and those that
    start in the same half shard's length are together.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    half = max(1, shard_bytes // 2)
    alone = F.col("size") > half
    sliced = sizes.select("anchor", "size", F.when(~alone, F.pmod(F.xxhash64("anchor"), F.lit(-(-total // (16 * half)) or 1))).alias("slice"))
    before = F.sum("size").over(Window.partitionBy("slice").orderBy("anchor").rowsBetween(Window.unboundedPreceding, -1))
    small = sliced.where("slice IS NOT NULL").withColumn("shard", (F.coalesce(before, F.lit(0)) / half).cast("bigint"))
    return small.union(sliced.where("slice IS NULL").withColumn("shard", F.col("anchor")))


def _shard_runs(length: int):
    """Of a shard's rows (anchor, whole, low, high, bytes), the runs of repeated starts of every segment."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique = {}
        for batch in batches:
            for anchor, whole, low, high, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "low", "high", "bytes")), strict=True):
                unique[anchor, whole] = (low, high, raw)  # a repeated row brings its segment twice
            del batch
        keys = sorted(unique)
        lows, highs = (np.array([unique[k][i] for k in keys], np.int64) for i in (0, 1))
        sizes = np.array([len(unique[k][2]) + 1 for k in keys], np.int64)
        raw = b"\0".join(unique[k][2] for k in keys) + b"\0"
        unique.clear()
        text = np.zeros(len(raw) + 1, np.uint16)  # 0 ends the text, 1 ends a segment
        np.add(np.frombuffer(raw, np.uint8), np.uint16(2), out=text[:-1])
        del raw
        starts = np.cumsum(sizes) - sizes
        text[starts + sizes - 1] = 1
        runs = _repeated_starts(text, starts, lows, highs, length)
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
        columns += [pa.array([r[i] for r in runs], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "starts", "stops"])

    return sort


def _sorted_in_shards(contents: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts of every segment, from the suffix order of its shard."""
    return contents.groupBy("slice", "shard").applyInArrow(_shard_runs(length), _RUNS)


def _counted_by_window(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors whose segments do not fit a shard: every window is counted by hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, whole, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = window_hashes(np.frombuffer(raw, np.uint8), length).view(np.int64)
                n = len(h)
                arrays = [pa.array(np.full(n, anchor)), pa.array(np.full(n, whole)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h)]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "whole", "place", "hash"])

    distinct = contents.groupBy("anchor", "whole").agg(F.first("bytes").alias("bytes"))
    rows = distinct.mapInArrow(windows, "anchor bigint, whole bigint, place int, hash bigint")
    twice = rows.groupBy("hash").count().where("count > 1").select("hash")
    hits = rows.join(twice, "hash").groupBy("anchor", "whole").agg(F.sort_array(F.collect_list("place")).alias("starts"))
    return hits.select("anchor", "whole", "starts", F.transform("starts", lambda s: s + 1).alias("stops"))


def repeated_runs(docs: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; runs: key, starts, stops of repeated starting places). ``docs``: id, key, text."""
    rows, classes = _classes(docs, length)
    parts = classes.select("key", F.explode("parts").alias("p")).select("key", "p.*")
    stats = parts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1"), F.max("twice").alias("any_twice"))
    stats = stats.where("n > 1 or any_twice").select("anchor", ((F.col("w0") != F.col("w1")) | F.col("any_twice")).alias("mixed"))
    hits = saved(parts.drop("twice").join(stats, "anchor"), "suffix-hits")
    alike = hits.where(~F.col("mixed")).select("key", F.col("low").alias("start"), F.col("high").alias("stop"))

    distinct = hits.where("mixed").groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "low", "high")).alias("at"))
    distinct = saved(distinct.select("anchor", "whole", "n", "at.*"), "suffix-distinct")
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("high") - F.col("low") + length - 1).alias("size"))
    sizes = saved(sizes, "suffix-sizes")
    dealt = _dealt(sizes.where(F.col("size") <= shard_bytes), shard_bytes)
    larger = sizes.where(F.col("size") > shard_bytes)
    dealt = dealt.union(larger.select("anchor", "size", F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    asked = distinct.groupBy("key").agg(F.collect_list(F.struct("anchor", "whole", "low", "high")).alias("asked"))
    asked = asked.join(classes.select("key", "id"), "key").withColumnRenamed("key", "asked_key").withColumnRenamed("id", "asked_id")
    found = docs.join(asked, docs["id"].eqNullSafe(F.col("asked_id")) & (F.col("key") == F.col("asked_key"))).select("text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            out = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                out += [x | {"bytes": raw[x["low"] : x["high"] + length - 1]} for x in asked]
            kinds = [("anchor", pa.int64()), ("whole", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in kinds], [n for n, _ in kinds])

    contents = found.mapInArrow(cut, "anchor bigint, whole bigint, low int, high int, bytes binary")
    contents = saved(contents.join(dealt, "anchor"), "suffix-contents")
    runs = _sorted_in_shards(contents.where("shard IS NOT NULL").drop("size"), length)
    if larger.take(1):
        runs = runs.union(_counted_by_window(contents.where("shard IS NULL").select("anchor", "whole", "bytes"), length))
    # segments that occur more than once repeat as a whole
    several = F.col("n") > 1
    spans = F.when(several, F.array(F.lit(0))).otherwise(F.col("starts")), F.when(several, F.array(F.col("high") - F.col("low"))).otherwise(F.col("stops"))
    known = distinct.join(runs, ["anchor", "whole"], "left").select("anchor", "whole", spans[0].alias("starts"), spans[1].alias("stops"))
    each = hits.where("mixed").join(known, ["anchor", "whole"]).select("key", "low", F.explode(F.arrays_zip("starts", "stops")).alias("r"))
    placed = each.select("key", (F.col("low") + F.col("r.starts")).alias("start"), (F.col("low") + F.col("r.stops")).alias("stop"))
    copies = classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("key", F.lit(0).alias("start"), (F.col("n_bytes") - length + 1).cast("int").alias("stop"))
    every = alike.union(placed).union(copies)
    return rows, every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def kept_bytes(raw: bytes, runs: list[dict], length: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed spans) for runs of repeated starts in ascending order."""
    left, at, removed, spans, end = [], 0, 0, 0, -1
    for run in runs:
        start, stop = run["start"], min(run["stop"] + length - 1, len(raw))
        if start > end:  # touching spans are one
            if end >= 0:
                removed += end - at
            left.append(raw[max(end, 0) : start])
            at, end, spans = start, stop, spans + 1
        else:
            end = max(end, stop)
    if end < 0:
        return raw, 0, 0
    left.append(raw[end:])
    return b"".join(left), removed + end - at, spans


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept_text and the row's other columns.

    Cuts fall between bytes; the pieces of a character that a cut leaves behind are dropped from kept_text, not from kept_sha256.
    """
    text = whole_text(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("key"), text.alias("text"))
    rows, runs = repeated_runs(narrow, length, shard_bytes)
    by_id = rows.join(runs, "key").dropDuplicates(["id", "key"]).select(F.col("id").alias("_run_id"), F.col("key").alias("_run_key"), F.col("runs").alias("_runs"))
    others = [c for c in docs.columns if c != text_col] if keep_text else [id_col]
    source = docs.select(*others, text.alias("_text"))
    met = source.join(by_id, F.col(id_col).eqNullSafe(F.col("_run_id")) & (F.md5("_text") == F.col("_run_key")), "left")
    met = met.select(*others, "_text", "_runs")
    names = [*others, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
    schema = met.drop("_text", "_runs").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(others)
        for batch in _few_rows(batches):
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, runs in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                left, n, m = kept_bytes(raw, runs or [], length)
                sizes.append(len(raw))
                removed.append(n)
                spans.append(m)
                digests.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left.decode("utf-8", "ignore"))
            arrays = [*batch.columns[:k], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())]
            if keep_text:
                arrays.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return met.mapInArrow(run, schema)
