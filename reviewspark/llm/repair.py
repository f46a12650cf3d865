"""Token ids in grammar-compressed shards: Re-Pair per shard, with expansion lengths for random access.

Documents are range-partitioned and sorted by id, tokenised in that order and gathered into shards of about a million ids.
A shard repeatedly replaces its frequent id pairs by nonterminals: every round counts all pairs, takes those that occur at
least `share` times as often as the commonest one, and replaces their occurrences from left to right; pairs never cross the
end of a document. Rules hold two earlier symbols and the number of ids they expand to, so any id range is decoded by a
search in the running lengths and the expansion of the symbols it touches.

Files are Parquet, one row per shard, written by Spark's committer to any file system: (part, shard, first_token, base,
doc_ids, doc_tokens, doc_symbols, symbols, rules). Order is (part, shard). No shard knows the ids before its own part; the
totals of parts, one row each, are summed when reading.

Defined results: null text is empty (only the end id is written); null ids come first; repeated ids stand side by side; an
empty table gives no files' rows and an empty result; other columns do not matter.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import whole_text
from .words import WordTable, mixed

SHARD_TOKENS = 1 << 20
LEAST = 16  # a pair is worth a rule (three numbers) from this count on
SHARE = 0.15
_HASH_BITS = 18


def frequent_pairs(seq: np.ndarray, open_: np.ndarray, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs worth replacing as left << 32 | right, sorted; positions whose pair may be one of them)."""
    keys = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:].astype(np.uint64)
    places = (mixed(keys) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
    places[~open_] = 1 << _HASH_BITS
    sizes = np.bincount(places, minlength=(1 << _HASH_BITS) + 1)
    sizes[-1] = 0
    # bins hold at least as many as their commonest pair, so no frequent pair is missed
    limit = max(least, int(sizes.max(initial=0) * share))
    at = np.flatnonzero(sizes[places] >= limit)
    pairs, counts = np.unique(keys[at], return_counts=True)
    return pairs[counts >= limit], at


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, share: float = SHARE):
    """(symbols, symbols per document, rules): rules is (k, 3) of left, right, expansion length; rule r is symbol base + r."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    lengths = np.ones(0, np.int64)
    made = 0
    while len(seq) > 1:
        pairs, at = frequent_pairs(seq, ~last[:-1], least, share)
        if not len(pairs):
            # one bin may hold several rare pairs that together pass; what is below the limit alone ends here
            break
        keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1].astype(np.uint64)
        which = np.searchsorted(pairs, keys)
        hit = pairs[np.minimum(which, len(pairs) - 1)] == keys
        at, which = at[hit], which[hit]
        # of hits in a row every second one is replaced
        run = np.append(True, np.diff(at) != 1)
        heads = np.flatnonzero(run)
        offset = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        at, which = at[offset % 2 == 0], which[offset % 2 == 0]
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = np.concatenate([lengths, np.ones(1, np.int64)])  # the last entry stands for ids
        size = known[np.where(left >= base, left - base, len(lengths))] + known[np.where(right >= base, right - base, len(lengths))]
        rules.append(np.stack([left, right, size], 1))
        lengths = np.concatenate([lengths, size])
        seq[at] = base + made + which
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        made += len(pairs)
    full = np.diff(np.append(0, ends)) > 0
    per_doc = np.zeros(len(ends), np.int64)
    per_doc[full] = np.diff(np.append(-1, np.flatnonzero(last)))
    return seq, per_doc, np.concatenate(rules) if rules else np.zeros((0, 3), np.int64)


class Grammar:
    """Decoder of one shard."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, base: int):
        self.symbols, self.rules, self.base = symbols.astype(np.int64), rules.astype(np.int64), base
        self.lengths = np.append(self.rules[:, 2], 1)

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        return self.lengths[np.where(symbols >= self.base, symbols - self.base, len(self.rules))]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Undo rules level by level until only ids are left."""
        while True:
            deep = symbols >= self.base
            if not deep.any():
                return symbols
            counts = np.where(deep, 2, 1)
            out = np.repeat(symbols, counts)
            at = (np.cumsum(counts) - counts)[deep]
            rule = self.rules[symbols[deep] - self.base]
            out[at], out[at + 1] = rule[:, 0], rule[:, 1]
            symbols = out

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)

    @functools.cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self._length(self.symbols))

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]


@functools.lru_cache(maxsize=2)
def library_table(path: str) -> WordTable:
    """Word table filled by the tokenizers library: each distinct word is encoded by it once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lists = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts

    return WordTable(encode_words, specials)


def library_encode(path: str) -> Callable:
    """Texts to (flat ids, ids per text) with the library's tokenizer file ``path``."""

    def encode(texts):
        return library_table(path).encode(texts)

    return encode


class _Shards:
    """Collects documents in order and gives out finished shards."""

    def __init__(self, part: int, shard_tokens: int):
        self.part, self.shard_tokens = part, shard_tokens
        self.shard, self.first = 0, 0
        self._reset()

    def _reset(self) -> None:
        self.keys, self.ids, self.counts, self.n = [], [], [], 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        start, ends = 0, np.cumsum(counts)
        while start < len(counts):
            before = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, before + self.shard_tokens - self.n)) + 1, len(counts))
            self.keys.append(keys[start:stop])
            self.counts.append(counts[start:stop])
            self.ids.append(ids[before : int(ends[stop - 1])])
            self.n += int(ends[stop - 1]) - before
            start = stop
            if self.n >= self.shard_tokens:
                yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.keys:
            return
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
        base = int(ids.max(initial=0)) + 1
        symbols, per_doc, rules = compress(ids, np.cumsum(counts), base)
        yield {
            "part": self.part, "shard": self.shard, "first_token": self.first, "n_tokens": len(ids), "base": base,
            "doc_ids": pa.concat_arrays(self.keys), "doc_tokens": counts.astype("<i4").tobytes(),
            "doc_symbols": per_doc.astype("<i4").tobytes(), "symbols": symbols.astype("<i4").tobytes(),
            "rules": rules.astype("<i4").tobytes(),
        }
        self.first += len(ids)
        self.shard += 1
        self._reset()


def write_shards(
    docs: DataFrame, out: str, encode: Callable, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Tokenise ``docs`` in ascending id order and write compressed shards to the folder ``out``."""
    narrow = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    ordered = narrow.repartitionByRange(F.col("id").asc_nulls_first(), F.hash("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    kind = narrow.schema["id"].dataType.simpleString()
    schema = (
        f"part int, shard int, first_token bigint, n_tokens bigint, base int, doc_ids array<{kind}>, "
        "doc_tokens binary, doc_symbols binary, symbols binary, rules binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, key_type = _Shards(TaskContext.get().partitionId(), shard_tokens), None
        for batch in batches:
            key_type = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, counts = encode(texts[a:b])
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                for row in shards.add(batch.column(0)[a:b], ids, counts):
                    yield _row(row, key_type)
        for row in shards.flush():
            yield _row(row, key_type)

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)


def _row(row: dict, key_type: pa.DataType) -> pa.RecordBatch:
    keys = row["doc_ids"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), None, *[pa.binary()] * 4]
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(key_type)) if name == "doc_ids" else pa.array([value], kind)
        for (name, value), kind in zip(row.items(), types, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, list(row))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with ``start``, the number of ids in all shards before."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per task that wrote
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return shards.join(offsets, "part").withColumn("start", F.col("before") + F.col("first_token")).drop("before")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Per document, decoded from the files: its id, start, n_tokens and ids_crc32; with ``keep_ids`` also the ids."""
    shards = read_shards(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"{id_col} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    fields = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                ints = lambda name: np.frombuffer(one[name].as_py(), "<i4")  # noqa: E731, B023
                ids = Grammar(ints("symbols"), ints("rules").reshape(-1, 3), one["base"].as_py()).all()
                counts = ints("doc_tokens").astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                keys = one["doc_ids"].values
                columns = [keys, pa.array(one["start"].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(np.split(ids.astype(np.int32), ends[:-1]), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, fields)

    columns = ["start", "base", "doc_ids", "doc_tokens", "symbols", "rules"]
    # a few shards at a time: a batch of thousands would not fit
    return shards.select(*columns).mapInArrow(run, schema)


def token_range(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids start..stop of the whole corpus. Reads only shards that overlap the range; the range must fit in memory."""
    shards = read_shards(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    out: list[int] = []
    for row in shards.select("start", "n_tokens", "base", "symbols", "rules").orderBy("start").toLocalIterator():
        grammar = Grammar(np.frombuffer(row.symbols, "<i4"), np.frombuffer(row.rules, "<i4").reshape(-1, 3), row.base)
        out += grammar.slice(max(0, start - row.start), min(row.n_tokens, stop - row.start)).tolist()
    return out
