"""Suffix order and common prefixes of one shard by induced sorting, with bulk queues that go to disk.

Suffixes are S-type (smaller than their successor) or L-type. The leftmost S-type ones are ordered first: their substrings
are sorted by the same induction and named, and the string of names is ordered recursively. From them a scan over the first
symbols in ascending order gives all L-type suffixes, and one in descending order all S-type ones. A scan takes what the queue
holds for a symbol and puts the suffixes one place to the left into the queue under their own first symbol, already in order. It
does so for a whole symbol at a time, with array operations. Queue entries carry the common prefix with the entry before:
one more than the smallest common prefix between their two sources.

A queue keeps `memory` bytes and writes the rest to an unlinked temporary file of its task (nothing else ever reads it); the
L-type suffixes wait for the second scan in such a queue too. The second scan hands on one symbol's suffixes at a time, so the
whole order is never held unless asked for. What is as long as the text are the text, a flag and the seeds (a third of it);
steps over seeds go by blocks.
Prefixes count up to `limit` symbols; suffixes that agree that far may stand in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MAX_SYMBOLS = 4096  # beyond it, the string of names is ordered by prefix doubling: a scan costs a step per symbol
QUEUE_MEMORY = 64 << 20
BLOCK = 1 << 16  # rows or symbols that are worked on at once


class BulkQueue:
    """Entries (position, common prefix) by first symbol, first in first out. Over budget, the fullest symbols go to disk."""

    def __init__(self, memory: int = QUEUE_MEMORY):
        self.memory, self.held = memory, 0
        self.chunks: dict[int, list] = {}
        self.sizes: dict[int, int] = {}
        self.file = None

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append((positions, prefixes))
        size = positions.nbytes + prefixes.nbytes
        self.sizes[symbol] = self.sizes.get(symbol, 0) + size
        self.held += size
        while self.held > self.memory:
            self._spill(max(self.sizes, key=self.sizes.__getitem__))

    def _spill(self, symbol: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        kept = []
        for chunk in self.chunks[symbol]:
            if isinstance(chunk[0], np.ndarray):
                at = self.file.seek(0, 2)
                chunk[0].tofile(self.file)
                chunk[1].tofile(self.file)
                self.file.flush()
                chunk = (at, len(chunk[0]))
            kept.append(chunk)
        self.chunks[symbol] = kept
        self.held -= self.sizes.pop(symbol)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        positions, prefixes = [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
        for chunk in self.chunks.pop(symbol, []):
            if not isinstance(chunk[0], np.ndarray):
                self.file.seek(chunk[0])
                chunk = (np.fromfile(self.file, np.int32, chunk[1]), np.fromfile(self.file, np.int16, chunk[1]))
            positions.append(chunk[0])
            prefixes.append(chunk[1])
        self.held -= self.sizes.pop(symbol, 0)
        prefix = np.concatenate(prefixes)
        prefix[:1] = 0
        return np.concatenate(positions), prefix

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """Is the suffix smaller than the next one? The last symbol is the unique smallest."""
    types = np.ones(len(text), bool)
    for stop in range(len(text) - 1, 0, -BLOCK):
        start = max(0, stop - BLOCK)
        here, after = text[start:stop], text[start + 1 : stop + 1]
        at = np.where(here != after, np.arange(len(here)), len(here))  # equal symbols: as the suffix to the right
        at = np.minimum.accumulate(at[::-1])[::-1]
        types[start:stop] = np.append(here < after, types[stop])[at]
    return types


def _range_minimum(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Smallest of values[start:stop] for each pair."""
    level = np.frexp((stops - starts).astype(np.float64))[1] - 1
    out, table = np.empty(len(starts), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        rows = np.flatnonzero(level == k)
        out[rows] = np.minimum(table[starts[rows]], table[stops[rows] - (1 << k)])
    return out


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to ``limit``; compared 16 at a time."""
    step = 16
    padded = np.concatenate([text, np.zeros(limit + 2 * step, text.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, step)
    out = np.zeros(len(a), np.int16)
    for row in range(0, len(a), BLOCK):
        live = np.arange(row, min(row + BLOCK, len(a)))
        for done in range(0, limit, step):
            if not len(live):
                break
            differ = view[a[live] + done] != view[b[live] + done]
            first = np.where(differ.any(1), differ.argmax(1), step)
            out[live] = np.minimum(done + first, limit)
            live = live[first == step]
    return out


class _Scan:
    """One scan, towards larger symbols (L-types) or smaller ones (S-types)."""

    def __init__(self, text: np.ndarray, ascending: bool, limit: int | None, memory: int):
        self.text, self.ascending, self.limit = text, ascending, limit
        self.queue = BulkQueue(memory)

    def _left(self, positions: np.ndarray, symbol: int, prefixes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes left of the chosen rows and their common prefixes within the row order."""
        out = positions[rows] - 1
        prefix = np.ones(len(rows), np.int16)
        if self.limit is not None and len(rows) > 1:
            least = _range_minimum(prefixes, rows[:-1] + 1, rows[1:] + 1)
            prefix[1:] = np.minimum(least.astype(np.int32) + 1, self.limit)
        return out, prefix

    def symbol(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of the scan's type that start with ``symbol``, in scan order."""
        positions, prefixes = self.queue.take(symbol)
        all_positions, all_prefixes, repeats = [positions], [prefixes], 0
        while len(positions):
            rows = np.flatnonzero((positions > 0) & (self.text[positions - 1] == symbol))
            repeats += 1
            positions, prefixes = self._left(positions, symbol, prefixes, rows)
            if len(prefixes):
                prefixes[0] = repeats if self.limit is None else min(repeats, self.limit)
            all_positions.append(positions)
            all_prefixes.append(prefixes)
        return np.concatenate(all_positions), np.concatenate(all_prefixes)

    def pass_on(self, positions: np.ndarray, prefixes: np.ndarray, symbol: int) -> None:
        """Queue the suffixes left of these under their first symbols, where that symbol lies ahead of the scan."""
        before = self.text[positions - 1]
        ahead = before > symbol if self.ascending else before < symbol
        rows = np.flatnonzero((positions > 0) & ahead)
        if not len(rows):
            return
        symbols = before[rows]
        order = np.argsort(symbols, kind="stable")
        rows, symbols = rows[order], symbols[order]
        heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        out = (positions[rows] - 1).astype(np.int32)
        prefix = np.ones(len(rows), np.int16)
        if self.limit is not None:
            inner = np.ones(len(rows), bool)
            inner[heads] = False
            k = np.flatnonzero(inner)
            if len(k):
                least = _range_minimum(prefixes, rows[k - 1] + 1, rows[k] + 1)
                prefix[k] = np.minimum(least.astype(np.int32) + 1, self.limit)
        for a, b in zip(heads, np.append(heads[1:], len(rows)), strict=True):
            self.queue.put(int(symbols[a]), out[a:b].copy(), prefix[a:b].copy())  # a slice would hold all of them


def _induce(
    text: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray | None, limit: int | None, memory: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, symbol by symbol from the largest, with common prefixes if ``limit`` is given (else not meant).

    ``seeds``: leftmost S-types in order.
    """
    symbols = np.unique(text).tolist()
    first = text[seeds]
    bounds = {s: (int(np.searchsorted(first, s)), int(np.searchsorted(first, s, "right"))) for s in symbols}

    def joined(a, pa, b, pb, seam_first_b):
        """Two runs of one symbol after each other; the seam is compared directly."""
        prefixes = np.concatenate([pa, pb])
        if len(a) and len(b):
            prefixes[len(a)] = seam_first_b
        return np.concatenate([a, b]), prefixes

    def seam(x: int, y: int) -> int:
        if limit is None:
            return 0
        return int(common_prefixes_of_two(text, x, y, limit))

    up = _Scan(text, True, limit, memory)
    l_runs = BulkQueue(memory)
    for s in symbols:
        positions, prefixes = up.symbol(s)
        l_runs.put(s, positions, prefixes)
        a, b = bounds[s]
        block, block_prefixes = seeds[a:b], (np.zeros(b - a, np.int16) if seed_prefixes is None else seed_prefixes[a:b].copy())
        block_prefixes[:1] = 0
        # L-types before S-types of the same symbol; every seed's left neighbour is an L-type with a larger symbol
        meet = seam(positions[-1], block[0]) if len(positions) and len(block) else 0
        stream, stream_prefixes = joined(positions, prefixes, block, block_prefixes, meet)
        up.pass_on(stream, stream_prefixes, s)
    up.queue.close()

    down = _Scan(text, False, limit, memory)
    for s in reversed(symbols):
        positions, prefixes = down.symbol(s)  # descending
        if s == symbols[0]:  # the sentinel is smallest and has no source
            positions, prefixes = np.array([len(text) - 1], np.int32), np.zeros(1, np.int16)
        l_positions, l_prefixes = l_runs.take(s)
        back_prefixes = np.concatenate([np.zeros(min(1, len(l_positions)), np.int16), l_prefixes[:0:-1]])
        meet = seam(positions[-1], l_positions[-1]) if len(positions) and len(l_positions) else 0
        stream, stream_prefixes = joined(positions, prefixes, l_positions[::-1], back_prefixes, meet)
        down.pass_on(stream, stream_prefixes, s)
        yield stream[::-1], np.concatenate([np.zeros(min(1, len(stream)), np.int16), stream_prefixes[:0:-1]])
    down.queue.close()
    l_runs.close()


def common_prefixes_of_two(text: np.ndarray, x: int, y: int, limit: int) -> int:
    a, b = text[x : x + limit], text[y : y + limit]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def _doubled(names: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes of a string of names by prefix doubling, exact up to ``limit`` names."""
    rank, step, n = names.astype(np.int32), 1, len(names)
    while True:
        key = rank.astype(np.int64)
        key *= n + 2
        key[: n - step] += rank[step:]
        key[: n - step] += 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
        step *= 2
        if step >= limit or step >= n or rank[order[-1]] == n - 1:
            return order


def _ordered_seeds(text: np.ndarray, limit: int, memory: int) -> np.ndarray:
    """Leftmost S-type positions in suffix order."""
    types = s_types(text)
    is_seed = np.append(False, types[1:] & ~types[:-1])
    del types
    seeds = np.flatnonzero(is_seed).astype(np.int32)
    if len(seeds) < 2:
        return seeds
    rough = seeds[np.argsort(text[seeds], kind="stable")]
    order, end = np.empty_like(seeds), len(seeds)
    for positions, _ in _induce(text, rough, None, None, memory):
        found = positions[is_seed[positions]]
        order[end - len(found) : end] = found
        end -= len(found)
    del rough, is_seed
    # substrings run to the next seed; equal neighbours get one name
    places = np.searchsorted(seeds, order).astype(np.int32)
    lengths = (np.append(seeds[1:], len(text) - 1) - seeds + 1)[places]
    same = lengths[:-1] == lengths[1:]
    for row in range(0, len(same), BLOCK):
        rows = row + np.flatnonzero(same[row : row + BLOCK])
        same[rows] = _equal_runs(text, order[rows], order[rows + 1], lengths[rows])
    names = np.cumsum(np.append(False, ~same), dtype=np.int32)
    if names[-1] == len(seeds) - 1:
        return order
    reduced = np.empty_like(names)
    reduced[places] = names
    few = names[-1] < MAX_SYMBOLS and len(reduced) > 64
    del order, places, lengths, same, names
    # every name but the last covers at least two symbols
    reach = limit // 2 + 2
    if few:
        ranks, _ = suffix_order(np.append(reduced + 1, 0).astype(np.int32), reach, False, memory)
        ranks = ranks[1:]
    else:
        ranks = _doubled(reduced, reach)
    return seeds[ranks]


def _equal_runs(text: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Are the slices of the same length at a and b equal?"""
    same = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        live = live[lengths[live] > done]
        equal = text[a[live] + done] == text[b[live] + done]
        same[live[~equal]] = False
        live = live[equal]
        done += 1
    return same


def suffix_runs(text: np.ndarray, limit: int, with_prefixes: bool = True, memory: int = QUEUE_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in suffix order, common prefix of each with the one before, up to ``limit``) by first symbol, largest first.

    The last symbol of ``text`` is smaller than all others and occurs once. Suffixes of different runs share nothing.
    """
    if len(text) == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.int16)
        return
    seeds = _ordered_seeds(text, limit, memory)
    prefixes = None
    if with_prefixes:
        prefixes = np.zeros(len(seeds), np.int16)
        prefixes[1:] = common_prefixes(text, seeds[:-1], seeds[1:], limit)
    yield from _induce(text, seeds, prefixes, limit if with_prefixes else None, memory)


def suffix_order(text: np.ndarray, limit: int, with_prefixes: bool = True, memory: int = QUEUE_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """The same in one piece, ascending."""
    order, shared, end = np.empty(len(text), np.int32), np.empty(len(text), np.int16), len(text)
    for positions, prefixes in suffix_runs(text, limit, with_prefixes, memory):
        start = end - len(positions)
        order[start:end], shared[start:end], end = positions, prefixes, start
    return order, shared
