"""Byte-level BPE by speculation: guess by longest match, verify the guess pair by pair, merge exactly only where it fails.

A sequence of tokens is what BPE gives for a word exactly if BPE leaves every two neighbours as they are. So all new words
of a batch are cut greedily into longest vocabulary entries, every distinct pair of neighbours is tested once by undoing
the merges along the seam, and only words with a failing pair are merged rule by rule. All three steps work on arrays of
words; results are kept per distinct word (`words.WordTable`). Each document costs a lookup per word. No shuffle: the job
is one narrow pass, and any lost task can be run again.

Defined results: a null text is an empty text (no ids, the digest of nothing); repeated rows give repeated rows; other
columns of the input do not matter; an empty table gives an empty table. Strings of special tokens inside a text become
their ids, as the library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Index, WordTable, hashes, mixed, spans

BATCH_BYTES = 1 << 20  # text handled by one array operation; several arrays of 8 bytes per character stand beside it
NEVER = np.int64(1) << 40
_PAIR = np.uint64(1 << 32)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left.astype(np.uint64) * _PAIR + right.astype(np.uint64) + np.uint64(1)) | np.uint64(1 << 63)


class Vocabulary:
    """A vocabulary file: tokens as bytes, merges by rank, and the three array steps of encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special_ids = set(self.specials.values())
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)  # -1: a single byte
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        made = pairs[:, 2]
        self.left[made], self.right[made], self.rank[made] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
        self.pairs = Index(18)
        self.pairs.add(_pair_keys(pairs[:, 0], pairs[:, 1]), made.astype(np.int32))
        self.verdicts = Index(16)
        self._longest()

    def _longest(self) -> None:
        """Vocabulary entries that BPE gives for their own bytes, by hash; only those are proposed."""
        ids = np.array([i for i, b in enumerate(self.bytes) if b and i not in self.special_ids], np.int64)
        sizes = np.array([len(self.bytes[i]) for i in ids], np.int64)
        data = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
        ends = np.cumsum(sizes)
        flat, counts = self.merge(data, ends - sizes, ends)
        own = (counts == 1) & (flat[np.cumsum(counts) - counts] == ids)
        self.tokens = Index(18)
        self.tokens.add(hashes(data, ends - sizes, ends)[own], ids[own].astype(np.int32))
        self.sizes = np.zeros(len(self.bytes), np.int64)
        self.sizes[ids] = sizes
        self.lengths = sorted(set(sizes[own].tolist()), reverse=True)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that a pair merges into, -1 if it never does."""
        return self.pairs.find(_pair_keys(left, right)).astype(np.int64)

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: (flat ids, ids per word)."""
        from .words import Rolling, inverse_powers

        rolling, inverse = Rolling(data), inverse_powers(len(data))
        at, word = starts.copy(), np.arange(len(starts))
        found_word, found_id = [], []
        while len(word):
            token = np.full(len(word), -1, np.int64)
            room = ends[word] - at
            for length in self.lengths:
                open_ = np.flatnonzero((token < 0) & (room >= length))
                if len(open_):
                    token[open_] = self.tokens.find(rolling.words(at[open_], at[open_] + length, inverse))
            found_word.append(word)
            found_id.append(token)
            at = at + self.sizes[token]
            more = at < ends[word]
            word, at = word[more], at[more]
        words = np.concatenate(found_word) if found_word else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        ids = (np.concatenate(found_id) if found_id else np.zeros(0, np.int64))[order]
        return ids, np.bincount(words, minlength=len(starts)).astype(np.int64)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Does BPE leave the two tokens side by side? Undoes merges on both sides of the seam, the latest first."""
        keys = _pair_keys(left, right)
        known = self.verdicts.find(keys)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            a, b = left[missing[one]].copy(), right[missing[one]].copy()
            next_a, next_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
            good = np.ones(len(a), np.int32)
            live = np.arange(len(a))
            while len(live):
                x, y = a[live], b[live]
                m = self.merged(x, y)
                rank = np.where(m >= 0, self.rank[m], NEVER)
                bad = (rank < next_a[live]) & (rank <= next_b[live]) & (m >= 0)
                good[live[bad]] = 0
                done = bad | ((self.rank[x] < 0) & (self.rank[y] < 0))
                live, x, y = live[~done], x[~done], y[~done]
                undo_left = self.rank[x] > self.rank[y]
                lefts, rights = live[undo_left], live[~undo_left]
                next_a[lefts] = self.rank[a[lefts]]
                a[lefts] = self.right[a[lefts]]
                next_b[rights] = self.rank[b[rights]]
                b[rights] = self.left[b[rights]]
            self.verdicts.add(fresh, good)
            known = self.verdicts.find(keys)
        return known == 1

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words at once: in each round every open word applies its lowest-ranked pair."""
        sizes = ends - starts
        ids = self.of_byte[data[spans(starts, sizes)]]
        word = np.repeat(np.arange(len(starts)), sizes)
        done_word, done_id = [], []
        while len(ids):
            made = np.full(len(ids), -1, np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            made[inner] = self.merged(ids[inner], ids[inner + 1])
            rank = np.where(made >= 0, self.rank[made], NEVER)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            runs = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            open_ = np.repeat(least < NEVER, runs)
            if not open_.all():
                done_word.append(word[~open_])
                done_id.append(ids[~open_])
                ids, word, rank, made = ids[open_], word[open_], rank[open_], made[open_]
                runs, least = runs[least < NEVER], least[least < NEVER]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, runs))
            firsts = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            ids[firsts] = made[firsts]
            keep = np.ones(len(ids), bool)
            keep[firsts + 1] = False
            ids, word = ids[keep], word[keep]
        words = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        flat = (np.concatenate(done_id) if done_id else np.zeros(0, np.int64))[order]
        return flat, np.bincount(words, minlength=len(starts)).astype(np.int64)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.propose(data, starts, ends)
        owner = np.repeat(np.arange(len(starts)), counts)
        seams = np.flatnonzero(owner[1:] == owner[:-1])
        fails = seams[~self.compatible(ids[seams], ids[seams + 1])]
        failing = np.unique(owner[fails])
        if not len(failing):
            return ids, counts
        exact, exact_counts = self.merge(data, starts[failing], ends[failing])
        redo = np.zeros(len(starts), bool)
        redo[failing] = True
        all_ids = np.concatenate([ids[~redo[owner]], exact])
        all_owner = np.concatenate([owner[~redo[owner]], np.repeat(failing, exact_counts)])
        order = np.argsort(all_owner, kind="stable")
        counts = counts.copy()
        counts[failing] = exact_counts
        return all_ids[order], counts

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def word_table(path: str) -> WordTable:
    vocab = vocabulary(path)
    return WordTable(vocab.encode_words, vocab.specials)


def chunks(texts: Sequence[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of about ``limit`` characters; a longer text stands alone."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def encode_texts(path: str, texts: Sequence[str]) -> Iterator[np.ndarray]:
    """Token ids (int32) of each text, in order."""
    table = word_table(path)
    for a, b in chunks(texts):
        ids, counts = table.encode(texts[a:b])
        yield from np.split(ids, np.cumsum(counts)[:-1])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also the ids (array<int>)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    fields = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            sizes, id_digests, text_digests, kept = [], [], [], []
            for ids in encode_texts(path, batch.column(1).to_pylist()):
                raw = ids.astype("<u4").tobytes()
                text = vocab.decode(ids.tolist())
                sizes.append(len(ids))
                id_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(hashlib.sha256(text.encode()).hexdigest())
                kept.append(ids)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, fields)

    return narrow.mapInArrow(run, schema)


def decode_column(path: str, ids: Column) -> Column:
    """Text of a column of token ids (array<int>); null stays null. Bytes that are not UTF-8 become U+FFFD."""
    @F.pandas_udf("string")
    def decoded(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return lists.map(lambda x: None if x is None else vocab.decode(x))

    return decoded(ids)
