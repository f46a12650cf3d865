"""Byte-level BPE pre-tokenisation of many texts at once, and a table from words to token ids.

Texts are cut with array operations instead of a regular expression per word: each code point has a class (letter, number,
white space, other), word starts are class changes, and the three special rules of the pattern (a space joins the next
word, a white-space run gives up its last character, English contractions) adjust those starts. A word is then known by a
64-bit hash of its bytes; `WordTable` gives token ids for the hashes seen so far in this Python worker.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
MAX_WORDS = 1_000_000  # words remembered per Python worker; beyond it the table starts anew, results are the same
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)))
    for label, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, points):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = label
    return table


@functools.cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n + 1 powers of the hash base modulo 2**64."""
    global _powers
    if len(_powers) <= n:
        grown = np.full(max(n + 1, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any slices of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.powers = powers(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * self.powers[: self.n], out=self.sums[1:])

    def words(self, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * inverse[starts]
        h = mixed(h + (ends - starts).astype(np.uint64) * _MIX)
        return np.where(h == 0, np.uint64(1), h)


_inverse_powers = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """Powers of the inverse of the hash base (it is odd, so it has one modulo 2**64)."""
    global _inverse_powers
    if len(_inverse_powers) <= n:
        grown = np.full(max(n + 1, 2 * len(_inverse_powers)), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        grown[0] = 1
        _inverse_powers = np.cumprod(grown)
    return _inverse_powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One non-zero 64-bit hash per slice; equal bytes give equal hashes in any array."""
    return Rolling(data).words(starts, ends, inverse_powers(len(data)))


def cut(pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, byte offset of each word and of the end, number of words per piece)."""
    joined = "".join(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(joined.encode(), np.uint8)
    n = len(points)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(pieces), np.int64)
    kinds = _classes()[points]
    opens = np.cumsum(sizes) - sizes
    first = np.zeros(n + 1, bool)
    first[opens[sizes > 0]] = True
    first[n] = True
    starts = first[:n].copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    # a white-space run before another character gives up its last one; a plain space then joins the next word
    after = np.flatnonzero(starts[1:] & ~first[1:n] & (kinds[:-1] == SPACE)) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    quotes = np.flatnonzero((points == 0x27) & starts)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kinds[quotes + 1] == LETTER) & ~first[quotes + 1]]
    if len(quotes):
        one = points[quotes + 1]
        two = np.where(first[quotes + 2], 0, points[np.minimum(quotes + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        quotes, width = quotes[hit], np.where(short, 2, 3)[hit]
        starts[quotes + 1] = False
        ends = quotes + width
        starts[ends[ends < n]] = True
        long_ends = quotes[width == 3]
        starts[long_ends + 2] = False
    at = np.flatnonzero(starts)
    words = np.diff(np.searchsorted(at, np.append(opens, n)))
    if len(data) == n:
        offsets = at
    else:
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = (np.cumsum(widths) - widths)[at]
    return data, np.append(offsets, len(data)), words


class Index:
    """Open-addressing table from non-zero 64-bit keys to int32 values, probed for whole arrays at once."""

    def __init__(self, bits: int = 16):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not there."""
        out = np.full(len(keys), -1, np.int32)
        place = (keys & np.uint64(self.mask)).astype(np.int64)
        seen = self.keys[place]
        hit = seen == keys
        out[hit] = self.values[place[hit]]
        left = np.flatnonzero(~hit & (seen != 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            seen = self.keys[place[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are distinct and not there yet."""
        if 2 * (self.n + len(keys)) > self.mask:
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(16, int(4 * len(keys)).bit_length()))
        self.n += len(keys)
        place = (keys & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[place[left]] == 0]
            self.keys[place[free]] = keys[free]  # of keys that meet in one place the last stays
            won = free[self.keys[place[free]] == keys[free]]
            self.values[place[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & self.mask


class Ragged:
    """Growing list of int32 lists in one flat array."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.counts) < self.n + len(counts):
            self.starts, self.counts = np.concatenate([self.starts] * 2), np.concatenate([self.counts] * 2)
        self.flat[self.used : self.used + len(flat)] = flat
        self.counts[self.n : self.n + len(counts)] = counts
        self.starts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.n += len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[rows]
        return self.flat[spans(self.starts[rows], counts)], counts


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of the slices (start, count), one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class WordTable:
    """Token ids of words. ``encode_words(data, starts, ends)`` gives (flat ids, ids per word) of distinct words."""

    def __init__(self, encode_words: Callable, specials: dict[str, int], max_words: int = MAX_WORDS):
        self.encode_words, self.specials, self.max_words = encode_words, specials, max_words
        self.pattern = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._clear()

    def _clear(self) -> None:
        self.index, self.lists = Index(), Ragged()

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text), as the tokenizer gives them one by one."""
        pieces, owners, special = [], [], []
        for k, text in enumerate(texts):
            last = 0
            if self.pattern and any(s in text for s in self.specials):
                for m in self.pattern.finditer(text):
                    pieces += [text[last : m.start()], ""]
                    owners += [k, k]
                    special += [-1, self.specials[m[0]]]
                    last = m.end()
            pieces.append(text[last:])
            owners.append(k)
            special.append(-1)
        if self.lists.n > self.max_words:
            self._clear()
        data, offsets, words = cut(pieces)
        rows = self._rows(data, offsets)
        ids, counts = self.lists.take(rows)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(words)])]
        per_piece = np.diff(ends)
        special = np.asarray(special, np.int64)
        if (special >= 0).any():
            at = np.flatnonzero(special >= 0)
            ids = np.insert(ids, ends[at], special[at])
            per_piece[at] += 1
        return ids, np.bincount(owners, per_piece, len(texts)).astype(np.int64)

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends = offsets[:-1], offsets[1:]
        keys = hashes(data, starts, ends)
        rows = self.index.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            one = missing[one]
            flat, counts = self.encode_words(data, starts[one], ends[one])
            self.index.add(fresh, np.arange(self.lists.n, self.lists.n + len(fresh), dtype=np.int32))
            self.lists.extend(flat, counts)
            rows[missing] = self.index.find(keys[missing])
        return rows
