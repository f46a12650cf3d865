"""Random forests over sparse vectors: wide nodes from histograms of all rows, narrow ones finished in tasks of their own.

Spark ML's forest sends a dense histogram of every node from every partition, which for deep trees is many times the rows,
and its model is an object per node on the driver. Here rows are binned once and kept as their non-zero entries. A table of
up to `LOCAL_ROWS` rows and `LOCAL_ENTRIES` entries goes whole to as many tasks as run at once, each of which grows its share
of the trees. Of a larger one, nodes above that size are split by histograms that are summed over the partitions, one round
per level for all trees; their open ends below it travel as rows to tasks, several to one task, which finish their
subtrees (Panda et al. 2009). In a task, nodes above `DENSE_ROWS` rows read only the entries of the features they try, column
by column; smaller ones are grown side by side over one dense block. So neither a task nor the driver sees a class, a tree's
rows or a table whole. The model is a table with one packed row per tree; tasks that score hold the packed trees, some bytes
per node, and unpack one at a time.

Counts are whole numbers per class, weighted only in the gain, so splits do not depend on the order in which rows are
summed. Every node tries exactly the square root of all features; a split needs a gain and `least` rows on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasSeed,
    HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, scratch_path

BINS = 32
ACCURACY = 500  # of the quantiles that become bin edges
POINTS = ACCURACY // 2  # values that a batch of rows gives of a feature
EDGE_TASKS = 32  # groups of features whose edges are found together
CHUNK_ROWS = 8192
LOCAL_ROWS = 1 << 18  # of the nodes that a task finishes
LOCAL_ENTRIES = 1 << 25  # their entries, three bytes each
TASK_ROWS = 1 << 16  # rows of a task that sums histograms, so that few sums of each node travel
FILLED = 16384  # rows that a task finishes at least, if there are as many
DENSE_ROWS = 2048  # nodes of more rows are split by the columns of their entries
SHRUNK = 8  # columns are sorted again for nodes that have shrunk to one in so many rows
BLOCK_ROWS = 4096  # of a dense block
SCORED_ROWS = 4096  # scored side by side; trees are unpacked once for them
CELLS = 96 << 20  # a dense block's rows times features, one byte each
PAIRS = 1 << 16  # cells of a node that are looked up at once
DENSE_KEYS = 32  # histograms with so many cells per entry are sorted instead
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_KINDS = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "zeros": np.int64, "ones": np.int64, "gain": np.float64}
_SUBTREE = "tree int, node long, depth int, " + ", ".join(f"{name} binary" for name in _KINDS)
_TREE = "tree int, size int, depth int, importance binary, share binary, " + ", ".join(f"{name} binary" for name in _KINDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _children(salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _mixed(salt * np.uint64(2) + np.uint64(1)), _mixed(salt * np.uint64(2) + np.uint64(2))


def _entries(features: str) -> list:
    """Places and values of a vector's stored entries; dense vectors hold a value in every place."""
    parts = F.unwrap_udt(F.col(features))
    places = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return [places.alias("places"), parts["values"].alias("values")]


def _points(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, rows) in order: of a feature with many values the middle ones of even runs, and its ends without weight."""
    order = np.argsort(values, kind="stable")
    order = order[_order(places[order])]
    places, values = places[order], values[order]
    first = np.flatnonzero(np.diff(places, prepend=-1))
    sizes = np.diff(np.append(first, len(places)))
    within, many = np.arange(len(places)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    run = np.where(many > POINTS, within * POINTS // np.maximum(many, 1), within)
    starts = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
    ends = np.append(starts, len(places))[1:]
    signs = np.flatnonzero(np.diff(values > 0, prepend=False))
    edge = np.unique(np.concatenate([first, first + sizes - 1, signs, signs[signs > 0] - 1]))
    at = np.concatenate([(starts + ends) // 2, edge])
    return places[at], values[at], np.append(ends - starts, np.zeros(len(edge), np.int64))


def bin_edges(rows: DataFrame, features: str, width: int) -> np.ndarray:
    """Upper edges of each feature's bins (width, BINS - 1): quantiles of its values, and what parts them from zero.

    Each batch of rows gives at most `POINTS` values of a feature with the rows they stand for, so ranks are off by no more
    than one in `ACCURACY`.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            kept = values != 0
            found = _points(places[kept], values[kept])
            part = found[0] % EDGE_TASKS
            for k in np.unique(part):
                own = part == k
                columns = [[_packed(a[own].astype(kind))] for a, kind in zip(found, (np.int32, np.float64, np.int32), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": [int(k)], **dict(zip("ivn", columns, strict=True))})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        i, v, n = (np.concatenate([_unpacked(b, kind) for b in parts[c]]) for c, kind in zip("ivn", (np.int32, np.float64, np.int32), strict=True))
        order = np.lexsort((v, i))
        i, v, n = i[order], v[order], n[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        out = []
        for low, high in zip(first, np.append(first, len(i))[1:], strict=True):
            values, ranks = v[low:high], np.cumsum(n[low:high])
            parting = [x / 2 for x in (values[values > 0][:1].sum(), values[values < 0][-1:].sum()) if x]
            met = values[np.searchsorted(ranks, np.arange(1, BINS - 3) / (BINS - 3) * ranks[-1])]
            out.append((int(i[low]), sorted(set(met[met < values[-1]].tolist()) | set(parting))))
        return pd.DataFrame(out, columns=["i", "edges"])

    sums = rows.select(*_entries(features)).mapInArrow(partial, "part long, i binary, v binary, n binary")
    edges = np.full((width, BINS - 1), np.inf)
    for i, own in sums.groupBy("part").applyInPandas(merge, "i int, edges array<double>").collect():  # one row per feature
        edges[i, : len(own)] = own
    return edges


@dataclass
class Shape:
    """What all tasks need to know of a forest."""

    trees: int
    max_depth: int
    least: int
    seed: int
    weights: tuple[float, float]
    edges: np.ndarray
    zero: np.ndarray = field(init=False)
    tried: int = field(init=False)
    order: np.ndarray = field(init=False)
    steps: np.ndarray = field(init=False)

    def __post_init__(self):
        width = len(self.edges)
        self.zero = (self.edges < 0).sum(axis=1).astype(np.uint8)
        self.tried = max(1, math.ceil(math.sqrt(width)))
        self.order = np.random.default_rng(self.seed).permutation(width)
        self.steps = np.flatnonzero(np.gcd(np.arange(1, width + 1), width) == 1) + 1

    def candidates(self, salt: np.ndarray) -> np.ndarray:
        """The features that each node tries: equal steps through a random order of all, without repetition."""
        width = len(self.order)
        step = self.steps[(_mixed(salt) % np.uint64(len(self.steps))).astype(np.int64)]
        start = (_mixed(salt + np.uint64(7)) % np.uint64(width)).astype(np.int64)
        return self.order[(start[:, None] + step[:, None] * np.arange(self.tried)) % width]

    def gini(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = counts[..., 1] * self.weights[1]
        total = counts[..., 0] * self.weights[0] + ones
        share = ones / np.maximum(total, 1e-300)
        return 2 * share * (1 - share), total

    def open(self, counts: np.ndarray, depth: int) -> np.ndarray:
        """Nodes that may be split."""
        zeros, ones = counts[:, 0], counts[:, 1]
        return (zeros > 0) & (ones > 0) & (zeros + ones >= 2 * self.least) & (depth < self.max_depth)


def _packed(a: np.ndarray) -> bytes:
    """Compressed, the bytes of all numbers place by place: high bytes are mostly zero."""
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Chunk:
    """Binned rows: label, and the places and bins of entries that are not in the zero bin."""

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, places: np.ndarray, bins: np.ndarray):
        self.labels, self.sizes, self.places, self.bins = labels, sizes, places, bins
        self.ends = np.cumsum(sizes)

    @classmethod
    def read(cls, labels: bytes, sizes: bytes, places: bytes, bins: bytes) -> Chunk:
        kinds = (np.uint8, np.int32, np.int32, np.uint8)
        labels, sizes, steps, bins = (_unpacked(b, kind) for b, kind in zip((labels, sizes, places, bins), kinds, strict=True))
        sums = np.append(0, np.cumsum(steps, dtype=np.int64))
        places = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
        return cls(labels, sizes, places.astype(np.uint16 if places.max(initial=0) < 1 << 16 else np.int32), bins)

    def written(self) -> list[bytes]:
        """The columns as bytes; places as steps from the one before in the row."""
        steps = np.diff(self.places.astype(np.int32), prepend=0)
        first = (self.ends - self.sizes)[self.sizes > 0]
        steps[first] = self.places[first]
        kinds = (np.uint8, np.int32, np.int32, np.uint8)
        return [_packed(a.astype(kind)) for a, kind in zip((self.labels, self.sizes, steps, self.bins), kinds, strict=True)]

    @classmethod
    def joined(cls, parts: list[Chunk]) -> Chunk:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("labels", "sizes", "places", "bins")])

    @classmethod
    def gathered(cls, parts: pd.DataFrame) -> Chunk:
        """The rows of all parts, which are dropped one by one as they are read."""
        labels, sizes = ([_unpacked(b, kind) for b in parts[c]] for c, kind in (("labels", np.uint8), ("sizes", np.int32)))
        total, out, low = int(sum(x.sum() for x in sizes)), None, 0
        blobs = [parts["places"].tolist(), parts["bins"].tolist()]
        parts.drop(columns=["places", "bins"], inplace=True)
        for i, own in enumerate(sizes):
            part = cls.read(_packed(labels[i]), _packed(own), blobs[0][i], blobs[1][i])
            blobs[0][i] = blobs[1][i] = None
            if out is None or out.places.dtype.itemsize < part.places.dtype.itemsize:
                wide = np.empty(total, part.places.dtype)
                if out is not None:
                    wide[:low] = out.places[:low]
                out = cls(np.concatenate(labels), np.concatenate(sizes), wide, np.empty(total, np.uint8) if out is None else out.bins)
            high = low + len(part.bins)
            out.places[low:high], out.bins[low:high], low = part.places, part.bins, high
        return out

    def dense(self, zero: np.ndarray) -> np.ndarray:
        """(rows, features), the rows of a feature side by side."""
        out = np.empty((len(zero), len(self.labels)), np.uint8)
        out[:] = zero[:, None]
        out.reshape(-1)[self.places * np.int64(len(self.labels)) + np.repeat(np.arange(len(self.labels)), self.sizes)] = self.bins
        return out.T

    def take(self, rows: np.ndarray) -> Chunk:
        sizes = self.sizes[rows]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(self.ends[rows] - sizes, sizes) + within
        return Chunk(self.labels[rows], sizes, self.places[at], self.bins[at])


def _order(nodes: np.ndarray) -> np.ndarray:
    """A stable order of small whole numbers; those of 16 bits are sorted by their digits."""
    return np.argsort(nodes.astype(np.uint16) if nodes.max(initial=0) < 1 << 16 else nodes, kind="stable")


def histograms(dense, labels, rows, nodes, times, tried, zero) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts per class): rows per node, tried feature and bin, without zero bins. Keys ascend."""
    if (nodes[1:] < nodes[:-1]).any():
        order = _order(nodes)
        rows, nodes, times = rows[order], nodes[order], times[order]
    columns, n, width, shifted, found = np.ascontiguousarray(dense.T).reshape(-1), len(dense), tried.shape[1], zero.any(), []
    for low in range(0, len(rows), PAIRS):
        r, k, t = rows[low : low + PAIRS], nodes[low : low + PAIRS], times[low : low + PAIRS]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        own, sizes = k[first], np.diff(np.append(first, len(k)))
        features = np.ascontiguousarray(tried[own].T)
        y, places, hits = labels[r], k * (width * BINS), []
        step = max(1, PAIRS // len(r))
        for j in range(0, width, step):
            at = np.repeat(features[j : j + step] * n, sizes, axis=1)
            at += r
            cells = columns[at.reshape(-1)]
            none = np.repeat(zero[features[j : j + step]], sizes, axis=1).reshape(-1) if shifted else 0
            hit = np.flatnonzero(cells != none)
            more, row = np.divmod(hit, len(r))
            hits.append(((places[row] + (j + more) * BINS + cells[hit]) * 2 + y[row], t[row]))
        found.append(_counted(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])))
    if len(found) == 1:
        return found[0]
    return summed(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros((0, 2))]))


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``times`` per key and class from keys that hold the class in their last bit."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros((0, 2))
    low = int(keys.min()) & ~1
    cells = (int(keys.max()) | 1) + 1 - low
    if cells <= DENSE_KEYS * len(keys):
        counts = np.bincount(keys - low, times, cells).reshape(-1, 2)
        met = np.flatnonzero(counts[:, 0] + counts[:, 1])
        return met + low // 2, counts[met]
    both, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, times, len(both))
    first = np.append(True, np.diff(both >> 1) != 0)
    out = np.zeros((int(first.sum()), 2))
    out[np.cumsum(first) - 1, both & 1] = counts
    return both[first] >> 1, out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, counts[:, y], len(keys)) for y in (0, 1)], 1)


def best_splits(shape: Shape, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, tried: np.ndarray):
    """Of each node that has a split with a gain: (node, feature, bin, gain, counts of the left side). Keys ascend."""
    width = tried.shape[1]
    fresh = np.append(True, np.diff(keys // BINS) != 0) if len(keys) else np.zeros(0, bool)
    groups = keys[fresh] // BINS
    rest = totals[groups // width] - (np.add.reduceat(counts, np.flatnonzero(fresh)) if len(keys) else counts)
    zero = shape.zero[tried[groups // width, groups % width]]
    keys, counts = np.concatenate([keys, groups * BINS + zero]), np.concatenate([counts, rest])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    running = np.cumsum(counts, axis=0)
    first = np.append(True, np.diff(keys // BINS) != 0) if len(keys) else np.zeros(0, bool)
    before = (running - counts)[first]
    left = running - np.repeat(before, np.diff(np.append(np.flatnonzero(first), len(keys))), axis=0)
    node = keys // BINS // width
    right = totals[node] - left
    (whole, total), (a, m), (b, n) = shape.gini(totals[node]), shape.gini(left), shape.gini(right)
    gain = whole - (m * a + n * b) / np.maximum(total, 1e-300)
    fits = (left[:, 0] + left[:, 1] >= shape.least) & (right[:, 0] + right[:, 1] >= shape.least) & (gain > 1e-12)
    node, gain, left, keys = node[fits], gain[fits], left[fits], keys[fits]
    if not len(node):
        return node, tried[node, node], keys, gain, left
    start = np.flatnonzero(np.append(True, np.diff(node) != 0))
    sizes = np.diff(np.append(start, len(node)))
    top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, start), sizes))
    best = top[np.append(True, np.diff(node[top]) != 0)]  # the smallest key of those with the largest gain
    feature = tried[node[best], keys[best] // BINS % width]
    return node[best], feature, keys[best] % BINS, gain[best], left[best]


def grow(shape: Shape, chunk: Chunk, times: np.ndarray, roots: np.ndarray, salts: np.ndarray, depths: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The subtrees of some nodes over the rows of ``chunk``, which count ``times`` each and belong to the node ``roots``.

    All are grown level by level side by side. In a subtree parents stand before their children, a left one before the right.
    """
    dense = chunk.dense(shape.zero)
    counts = np.stack([np.bincount(roots, times * (chunk.labels == y), len(salts)) for y in (0, 1)], 1)
    parts, size, tree, depth = [], len(salts), np.arange(len(salts)), depths
    rows = _order(roots)
    nodes = roots[rows]
    while True:
        n = len(counts)
        level = {
            "tree": tree, "depth": depth, "feature": np.full(n, -1), "bin": np.zeros(n, np.int64), "left": np.full(n, -1),
            "zeros": counts[:, 0].astype(np.int64), "ones": counts[:, 1].astype(np.int64), "gain": np.full(n, -1.0),
        }
        parts.append(level)
        open_ = shape.open(counts, depth)
        kept = open_[nodes]
        rows, nodes = rows[kept], nodes[kept]
        if not len(rows):
            break
        place = np.cumsum(open_) - 1
        tried, totals = shape.candidates(salts[open_]), counts[open_]
        keys, cells = histograms(dense, chunk.labels, rows, place[nodes], times[rows], tried, shape.zero)
        split, feature, bins, gain, left = best_splits(shape, keys, cells, totals, tried)
        if not len(split):
            break
        where = np.flatnonzero(open_)[split]
        level["feature"][where], level["bin"][where], level["gain"][where] = feature, bins, gain
        level["left"][where] = size + 2 * np.arange(len(split))
        rank = np.full(n, -1)
        rank[where] = np.arange(len(split))
        kept = rank[nodes] >= 0
        rows, nodes = rows[kept], rank[nodes[kept]]
        nodes = 2 * nodes + (dense[rows, feature[nodes]] > bins[nodes])
        order = _order(nodes)
        rows, nodes = rows[order], nodes[order]
        counts = np.stack([left, totals[split] - left], 1).reshape(-1, 2)
        salts = np.stack(_children(salts[where]), 1).reshape(-1)
        tree, depth = np.repeat(tree[where], 2), np.repeat(depth[where] + 1, 2)
        size += 2 * len(split)
    whole = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    return _apart(whole, len(depths))


def _apart(nodes: dict[str, np.ndarray], trees: int) -> list[dict[str, np.ndarray]]:
    """The nodes of each tree, numbered within it, from nodes of several."""
    order = np.argsort(nodes["tree"], kind="stable")
    cuts = np.searchsorted(nodes["tree"][order], np.arange(trees + 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - cuts[nodes["tree"][order]]
    nodes = nodes | {"left": np.where(nodes["left"] < 0, -1, place[nodes["left"]])}
    return [{name: a[order[low:high]] for name, a in nodes.items()} for low, high in zip(cuts[:-1], cuts[1:], strict=True)]


def _joined(upper: dict[str, np.ndarray], ends: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """A tree from its upper nodes and the subtrees that grow from some of them; the subtrees' other nodes come after all."""
    sizes = [len(e["left"]) - 1 for e in ends.values()]
    out = {name: np.concatenate([a, *[e[name][1:] for e in ends.values()]]) for name, a in upper.items()}
    start = len(upper["left"])
    for (at, e), size in zip(ends.items(), sizes, strict=True):
        for name in out:
            out[name][at] = e[name][0]
        moved = np.where(e["left"] < 0, -1, e["left"] + start - 1)
        out["left"][at], out["left"][start : start + size] = moved[0], moved[1:]
        start += size
    return out


class Top:
    """The nodes of some trees that are known so far: on the driver those that were ever wide, and their children."""

    def __init__(self, salt: np.ndarray, depth: np.ndarray):
        n = len(salt)
        self.tree, self.depth, self.salt = np.arange(n), depth, salt
        self.feature, self.bin, self.left = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        self.counts, self.gain = np.zeros((n, 2)), np.full(n, -1.0)

    @classmethod
    def of(cls, shape: Shape) -> Top:
        return cls(_mixed(np.arange(shape.trees, dtype=np.uint64) + np.uint64(shape.seed << 20)), np.zeros(shape.trees, np.int64))

    def split(self, node, feature, bins, gain, totals, left) -> np.ndarray:
        """Enter splits and return their children, the left one before the right."""
        self.feature[node], self.bin[node], self.gain[node], self.counts[node] = feature, bins, gain, totals
        self.left[node] = len(self.tree) + 2 * np.arange(len(node))
        twice = np.repeat(node, 2)
        none = np.full(len(twice), -1)
        self.tree, self.depth = np.append(self.tree, self.tree[twice]), np.append(self.depth, self.depth[twice] + 1)
        self.salt = np.append(self.salt, np.stack(_children(self.salt[node]), 1).reshape(-1))
        self.feature, self.left = np.append(self.feature, none), np.append(self.left, none)
        self.bin, self.gain = np.append(self.bin, np.zeros(len(twice), np.int64)), np.append(self.gain, np.full(len(twice), -1.0))
        self.counts = np.concatenate([self.counts, np.stack([left, totals - left], 1).reshape(-1, 2)])
        return np.arange(len(self.tree) - len(twice), len(self.tree))

    def reach(self, dense: np.ndarray, rows: np.ndarray, node: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``rows``, all of the tree ``node``, that end in a node that is ``chosen``, with that node."""
        columns, n, at, found = dense.T.reshape(-1), len(dense), np.full(len(rows), node), []
        while len(rows):
            feature = self.feature[at]
            done = feature < 0
            if done.any():
                end = done & chosen[at]
                found.append((rows[end], at[end]))
                rows, at, feature = rows[~done], at[~done], feature[~done]
            at = self.left[at] + (columns[feature * n + rows] > self.bin[at])
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))

    def nodes(self) -> dict[str, np.ndarray]:
        zeros, ones = self.counts.astype(np.int64).T
        return {
            "tree": self.tree, "depth": self.depth, "feature": self.feature, "bin": self.bin, "left": self.left,
            "zeros": zeros, "ones": ones, "gain": self.gain,
        }


def _columns(shape: Shape, chunk: Chunk, rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of some rows feature by feature, in blocks of rows: (first place in ``rows``, places after it, bins, where each feature starts)."""
    blocks = []
    for low in range(0, len(rows), BLOCK_ROWS):
        part = chunk.take(rows[low : low + BLOCK_ROWS])
        order = _order(part.places)
        owner = np.repeat(np.arange(len(part.labels), dtype=np.uint16), part.sizes)[order]
        blocks.append((low, owner, part.bins[order], np.append(0, np.cumsum(np.bincount(part.places, minlength=len(shape.zero))))))
    return blocks


def _split_large(
    shape: Shape, chunk: Chunk, times: np.ndarray, rows: np.ndarray, node: int, top: Top,
) -> list[tuple[int, np.ndarray]]:
    """Split a node by the columns of its entries, and what grows from it as long as it stays large; returns the ends with their rows."""
    least, width = max(DENSE_ROWS, len(rows) // SHRUNK), shape.tried
    at, blocks, labels, times = np.full(len(rows), node), _columns(shape, chunk, rows), chunk.labels[rows], times[rows]
    now = np.array([node])
    while len(now):
        tried, found = shape.candidates(top.salt[now]), []
        for k, features in enumerate(tried):
            hits = []
            for low, owner, bins, starts in blocks:
                sizes = starts[features + 1] - starts[features]
                places = np.repeat(starts[features] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                row = owner[places].astype(np.int64) + low
                own = np.flatnonzero(at[row] == now[k])
                row, cell = row[own], np.repeat(np.arange(width) * BINS, sizes)[own] + bins[places[own]]
                hits.append(((k * width * BINS + cell) * 2 + labels[row], times[row]))
            found.append(_counted(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])))
        keys, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        totals = top.counts[now]
        split, feature, bin_, gain, left = best_splits(shape, keys, counts, totals, tried)
        children = top.split(now[split], feature, bin_, gain, totals[split], left)
        for i, k in enumerate(split):
            own = [(slice(starts[feature[i]], starts[feature[i] + 1]), low, owner, bins) for low, owner, bins, starts in blocks]
            parts = [(owner[part].astype(np.int64) + low, bins[part]) for part, low, owner, bins in own]
            row, right = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) > bin_[i]
            met = at[row] == now[k]
            at[at == now[k]] = children[2 * i] + int(shape.zero[feature[i]] > bin_[i])
            at[row[met]] = children[2 * i] + right[met]
        sizes = np.bincount(at, minlength=len(top.tree))[children]
        now = children[(sizes >= least) & shape.open(top.counts[children], top.depth[children])]
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    return [(int(at[own[0]]), rows[own]) for own in np.split(order, first[1:])]


def grown(
    shape: Shape, chunk: Chunk, times: np.ndarray, roots: np.ndarray, salts: np.ndarray, depths: np.ndarray,
) -> list[dict[str, np.ndarray]]:
    """What `grow` gives, for any number of rows: large nodes are split by columns, the others grown in dense blocks.

    Rows that no tree draws may have any root.
    """
    top, drawn = Top(salts, depths), np.flatnonzero(times)
    top.counts = np.stack([np.bincount(roots, times * (chunk.labels == y), len(salts)) for y in (0, 1)], 1)
    order = drawn[_order(roots[drawn])]
    todo = list(enumerate(np.split(order, np.cumsum(np.bincount(roots[drawn], minlength=len(salts)))[:-1])))
    small, ends = [], {}
    while todo:
        node, rows = todo.pop()
        if not shape.open(top.counts[[node]], top.depth[[node]])[0]:
            continue
        if len(rows) <= DENSE_ROWS:
            small.append((node, rows))
            continue
        before = len(top.tree)
        more = _split_large(shape, chunk, times, rows, node, top)
        if len(top.tree) > before:  # else it has no split
            todo += more
    block, most = [], max(1, min(BLOCK_ROWS, CELLS // len(shape.zero)))
    small.sort(key=lambda x: x[0])
    for i, (node, rows) in enumerate(small):
        block.append((node, rows))
        if i + 1 == len(small) or sum(len(b[1]) for b in block) + len(small[i + 1][1]) > most:
            nodes, own = np.array([b[0] for b in block]), np.concatenate([b[1] for b in block])
            within = np.repeat(np.arange(len(block)), [len(b[1]) for b in block])
            ends |= zip(nodes.tolist(), grow(shape, chunk.take(own), times[own], within, top.salt[nodes], top.depth[nodes]), strict=True)
            block = []
    return _whole(top, ends, len(salts))


def _whole(top: Top, ends: dict[int, dict[str, np.ndarray]], trees: int) -> list[dict[str, np.ndarray]]:
    """The trees of ``top`` with the subtrees that grow from some of its nodes."""
    place = np.zeros(len(top.tree), np.int64)
    for tree in range(trees):
        own = np.flatnonzero(top.tree == tree)
        place[own] = np.arange(len(own))
    met: list[dict] = [{} for _ in range(trees)]
    for node in sorted(ends):
        met[top.tree[node]][int(place[node])] = ends[node]
    return [_joined(upper, found) for upper, found in zip(_apart(top.nodes(), trees), met, strict=True)]


def _draws(shape: Shape, chunk: int, n: int, trees: np.ndarray | None = None) -> np.ndarray:
    """How often each tree draws each row (rows, trees): a Poisson number, from the row's place in the table."""
    at = _mixed(np.uint64(chunk << 20) + np.arange(n, dtype=np.uint64) + np.uint64(shape.seed << 52))
    trees = np.arange(shape.trees) if trees is None else trees
    mixed = _mixed(at[:, None] + _mixed(trees.astype(np.uint64) + np.uint64(1)))
    return np.searchsorted(_POISSON, (mixed >> np.uint64(11)) / float(1 << 53), side="right")


def _bins(edges: np.ndarray, features: np.ndarray, values: np.ndarray) -> np.ndarray:
    bins = np.empty(len(values), np.uint8)
    for a in range(0, len(values), PAIRS):
        bins[a : a + PAIRS] = (edges[features[a : a + PAIRS]] < values[a : a + PAIRS, None]).sum(axis=1)
    return bins


def binned(rows: DataFrame, features: str, edges: np.ndarray) -> DataFrame:
    """Chunks of binned rows (chunk, labels, sizes, places, bins)."""
    most = max(1, min(CHUNK_ROWS, CELLS // len(edges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                labels, places, values = (batch.column(i)[low : low + most] for i in range(3))
                sizes = np.diff(places.offsets.to_numpy())
                flat, v = places.flatten().to_numpy(), values.flatten().to_numpy()
                kept = v != 0
                owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
                flat, v = flat[kept], v[kept]
                bins = _bins(edges, flat, v)
                parted = bins != zero[flat]
                owner, flat, bins = owner[parted], flat[parted], bins[parted]
                chunk = Chunk(labels.to_numpy().astype(np.uint8), np.bincount(owner, minlength=len(sizes)), flat, bins)
                names = ["labels", "sizes", "places", "bins"]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [number], **dict(zip(names, [[b] for b in chunk.written()], strict=True)), "entries": [len(bins)]}
                )
                number += 1

    zero = (edges < 0).sum(axis=1).astype(np.uint8)
    schema = "chunk long, labels binary, sizes binary, places binary, bins binary, entries long"
    return checkpoint(rows.select(F.col("label").cast("int").alias("label"), *_entries(features)).mapInArrow(run, schema))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, *parts = (batch.column(c)[i].as_py() for c in range(5))  # the number of entries is left where it is
            yield number, Chunk.read(*parts)


def _routed(shape: Shape, number: int, chunk: Chunk, dense: np.ndarray, top: Top, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that end in ``chosen`` nodes, those nodes, and how often the node's tree draws the row."""
    times = _draws(shape, number, len(chunk.labels))
    trees = np.unique(top.tree[chosen])
    met = [top.reach(dense, np.flatnonzero(times[:, tree]), int(tree), chosen) for tree in trees]
    rows, nodes = (np.concatenate([m[i] for m in met] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return rows, nodes, times[rows, np.repeat(trees, np.array([len(m[0]) for m in met], np.int64))]


def _split_wide(shape: Shape, chunks: DataFrame, top: Top, wide: np.ndarray) -> np.ndarray:
    """Split the nodes ``wide`` by histograms of all rows; returns their children."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.full(len(top.tree), -1)
        rank[wide] = np.arange(len(wide))
        tried = shape.candidates(top.salt[wide])
        parts, totals = [], np.zeros((len(wide), 2))
        for number, chunk in _chunks(batches):
            dense = chunk.dense(shape.zero)
            rows, nodes, times = _routed(shape, number, chunk, dense, top, rank >= 0)
            nodes = rank[nodes]
            for y in (0, 1):
                totals[:, y] += np.bincount(nodes, times * (chunk.labels[rows] == y), len(wide))
            parts.append(histograms(dense, chunk.labels, rows, nodes, times, tried, shape.zero))
            if len(parts) > 8:
                parts = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
        if parts:
            keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            each = shape.tried * BINS
            cuts = np.searchsorted(keys, np.arange(len(wide) + 1) * each)
            for k in np.flatnonzero(totals.sum(axis=1)):
                a, b = cuts[k], cuts[k + 1]
                yield pa.RecordBatch.from_pydict({
                    "node": [int(k)], "keys": [(keys[a:b] % each).astype(np.int32).tobytes()],
                    "counts": [counts[a:b].astype(np.int32).tobytes()], "zeros": [int(totals[k, 0])], "ones": [int(totals[k, 1])],
                })

    def best(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        tried = shape.candidates(top.salt[wide[[key[0]]]])
        keys = np.concatenate([np.frombuffer(b, np.int32) for b in parts["keys"]]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in parts["counts"]]).astype(float)
        totals = np.array([[parts["zeros"].sum(), parts["ones"].sum()]], float)
        found = [(-1, 0, -1.0, 0.0, 0.0)]
        if shape.open(totals, int(top.depth[wide[key[0]]]))[0]:
            _, feature, bins, gain, left = best_splits(shape, *summed(keys, counts), totals, tried)
            found = [(int(f), int(b), float(g), *map(float, c)) for f, b, g, c in zip(feature, bins, gain, left)] or found
        return pd.DataFrame([(key[0], *found[0], *totals[0])], columns=["node", "feature", "bin", "gain", "left0", "left1", "zeros", "ones"])

    sums = chunks.mapInArrow(partial, "node long, keys binary, counts binary, zeros long, ones long")
    schema = "node long, feature int, bin int, gain double, left0 double, left1 double, zeros double, ones double"
    met = sums.groupBy("node").applyInPandas(best, schema).toPandas().sort_values("node")  # one row per wide node
    top.counts[wide[met["node"]]] = met[["zeros", "ones"]].to_numpy()
    met = met[met["feature"] >= 0]
    return top.split(
        wide[met["node"].to_numpy()], met["feature"].to_numpy(), met["bin"].to_numpy(), met["gain"].to_numpy(),
        met[["zeros", "ones"]].to_numpy(), met[["left0", "left1"]].to_numpy(),
    )


def _packed_subtrees(nodes: Sequence[int], trees: Sequence[int], found: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([
        {"tree": tree, "node": node, "depth": own["depth"].max()} | {name: _stored(own[name], kind) for name, kind in _KINDS.items()}
        for node, tree, own in zip(nodes, trees, found, strict=True)
    ])


def _grown_whole(shape: Shape, chunks: DataFrame, top: Top, tasks: int) -> DataFrame:
    """All trees, each grown by one of ``tasks`` tasks that hold all rows."""
    spark = chunks.sparkSession
    # a key for every task, so that no two tasks' rows meet in one
    slot = F.pmod(F.hash(F.col("id")), F.lit(tasks)).alias("slot")
    keys = {r["slot"]: r["id"] for r in spark.range(64 * tasks).select("id", slot).groupBy("slot").agg(F.min("id").alias("id")).collect()}
    keys = sorted(keys.values())
    share = {key: np.arange(i, shape.trees, len(keys)) for i, key in enumerate(keys)}

    def finish(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts, trees, out = parts.sort_values("chunk"), share[key[0]], []
        drawn = [_draws(shape, number, len(_unpacked(b, np.uint8)), trees).astype(np.uint8) for number, b in zip(parts["chunk"], parts["labels"], strict=True)]
        times, chunk = np.concatenate(drawn), Chunk.gathered(parts)
        roots = np.zeros(len(times), np.int64)
        for i, tree in enumerate(trees):
            found = grown(shape, chunk, times[:, i].astype(np.int64), roots, top.salt[[tree]], top.depth[[tree]])
            out.append(_packed_subtrees([tree], [tree], found))
        return pd.concat(out)

    copies = chunks.drop("entries").withColumn("group", F.explode(F.array(*[F.lit(k).cast("long") for k in keys])))
    return copies.repartition(tasks, "group").groupBy("group").applyInPandas(finish, _SUBTREE)


def _grown_ends(shape: Shape, chunks: DataFrame, top: Top, narrow: np.ndarray, group: np.ndarray) -> DataFrame:
    """The subtrees of the nodes ``narrow``, grown in one task per ``group`` from their rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.full(len(top.tree), -1)
        into[narrow] = group
        for number, chunk in _chunks(batches):
            rows, nodes, times = _routed(shape, number, chunk, chunk.dense(shape.zero), top, into >= 0)
            order = np.lexsort((rows, nodes, into[nodes]))
            rows, nodes, times = rows[order], nodes[order], times[order]
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(into[nodes])) + 1) if len(rows) else ():
                labels, sizes, places, bins = chunk.take(rows[part]).written()
                yield pa.RecordBatch.from_pydict({
                    "group": [int(into[nodes[part[0]]])], "chunk": [number], "labels": [labels], "sizes": [sizes], "places": [places],
                    "bins": [bins], "nodes": [_packed(nodes[part].astype(np.int32))], "times": [_packed(times[part].astype(np.uint8))],
                })

    def finish(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("chunk")
        chunk = Chunk.gathered(parts)
        times = np.concatenate([_unpacked(b, np.uint8) for b in parts["times"]]).astype(np.int64)
        own, roots = np.unique(np.concatenate([_unpacked(b, np.int32) for b in parts["nodes"]]), return_inverse=True)
        found = grown(shape, chunk, times, roots, top.salt[own], top.depth[own])
        return _packed_subtrees(own, top.tree[own], found)

    schema = "group long, chunk long, labels binary, sizes binary, places binary, bins binary, nodes binary, times binary"
    return chunks.mapInArrow(send, schema).groupBy("group").applyInPandas(finish, _SUBTREE)


def _trees(shape: Shape, top: Top, ends: DataFrame) -> DataFrame:
    """All trees, packed, from their upper nodes and the subtrees that grow from those."""
    spark = ends.sparkSession
    upper = top.nodes()

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        own = np.flatnonzero(upper["tree"] == key[0])
        place = np.zeros(len(upper["tree"]), np.int64)
        place[own] = np.arange(len(own))
        tree = {name: upper[name][own].astype(kind) for name, kind in _KINDS.items()}
        tree["left"] = np.where(tree["left"] < 0, -1, place[tree["left"]]).astype(np.int32)
        parts = parts[parts["node"] >= 0].sort_values("node")
        ends = {int(place[row["node"]]): {name: _read(row[name], kind) for name, kind in _KINDS.items()} for row in parts.to_dict("records")}
        tree = _joined(tree, ends)
        weighed = np.stack([tree["zeros"], tree["ones"]], 1) * np.array(shape.weights)
        total, split = weighed.sum(axis=1), tree["feature"] >= 0
        gains = np.bincount(tree["feature"][split], tree["gain"][split] * total[split], len(shape.edges))
        share = np.where(split, 0.0, weighed[:, 1] / np.maximum(total, 1e-300))
        return pd.DataFrame([{
            "tree": key[0], "size": len(total), "depth": int(max(upper["depth"][own].max(), parts["depth"].max() if len(parts) else 0)),
            "importance": _stored(gains / (gains.sum() or 1.0), np.float64), "share": _stored(share, np.float64),
        } | {name: _stored(tree[name], kind) for name, kind in _KINDS.items()}])

    all_ = spark.range(shape.trees).select(F.col("id").cast("int").alias("tree"), F.lit(-1).cast("long").alias("node"))
    return ends.unionByName(all_, allowMissingColumns=True).groupBy("tree").applyInPandas(whole, _TREE)


def _grown_apart(shape: Shape, chunks: DataFrame, top: Top, n: int, most: int, cores: int) -> DataFrame:
    """Splits nodes of more than ``most`` rows by rounds over all rows, which enter ``top``, then has the others finished."""
    few = chunks.coalesce(max(cores, math.ceil(n / TASK_ROWS)))
    wide, narrow = np.arange(shape.trees), np.zeros(0, np.int64)
    while len(wide):
        new = _split_wide(shape, few, top, wide)
        new = new[shape.open(top.counts[new], top.depth[new])]
        large = top.counts[new].sum(axis=1) > most // 2  # a task holds them beside their bytes
        wide, narrow = new[large], np.append(narrow, new[~large])
    counts = top.counts[narrow].sum(axis=1)
    fill, group, held = min(most, max(FILLED, int(counts.sum()) // (8 * cores))), [], 0.0
    for count in counts:  # one number per narrow node
        fresh = not group or held + count > fill
        group.append(len(group) and group[-1] + fresh)
        held = count if fresh else held + count
    return _grown_ends(shape, chunks, top, narrow, np.array(group, np.int64))


def fit_forest(
    classifier: RandomForestClassifier, rows: DataFrame, sizes: dict[int, int], weights: Sequence[float] = (1.0, 1.0), local_rows: int = LOCAL_ROWS,
) -> ForestModel:
    """The forest that ``classifier`` describes, over 0/1 labels with the rows ``sizes`` and the ``weights`` of classes 0 and 1."""
    features, spark, n = classifier.getFeaturesCol(), rows.sparkSession, sum(sizes.values())
    width = rows.select(features).first()[0].size
    edges = bin_edges(rows, features, width)
    shape = Shape(
        classifier.getNumTrees(), classifier.getMaxDepth(), classifier.getMinInstancesPerNode(), classifier.getSeed() & 0xFFF,
        (float(weights[0]), float(weights[1])), edges,
    )
    chunks, top = binned(rows, features, edges), Top.of(shape)
    entries = chunks.agg(F.sum("entries")).first()[0] or 0
    most = max(1, min(local_rows, int(LOCAL_ENTRIES * n / max(1, entries))))
    cores = spark.sparkContext.defaultParallelism
    if n <= most:
        ends = _grown_whole(shape, chunks, top, min(shape.trees, cores))
    else:
        ends = _grown_apart(shape, chunks, top, n, most, cores)
    home = scratch_path(spark, "forest")
    _trees(shape, top, ends).write.parquet(f"{home}/trees")
    spark.createDataFrame([(width, _stored(edges.reshape(-1), np.float64))], "width int, edges binary").write.parquet(f"{home}/shape")
    return ForestModel.of(classifier, home)


# -- the model -------------------------------------------------------------------------------------------


def _stored(a: np.ndarray, kind: type) -> bytes:
    raw = np.ascontiguousarray(a, kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _read(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def leaf_shares(dense: np.ndarray, tree: Sequence[bytes]) -> np.ndarray:
    """The share of class 1 in the leaf of one packed tree (feature, bin, left, share) that each row reaches."""
    feature, cut, left, share = (_read(b, kind) for b, kind in zip(tree, (np.int32, np.uint8, np.int32, np.float64), strict=True))
    columns, n = dense.T.reshape(-1), len(dense)
    rows, out = np.arange(n), np.empty(n)
    node = np.zeros(n, np.int64)
    while len(rows):
        tried = feature[node]
        end = tried < 0
        if end.any():
            out[rows[end]] = share[node[end]]
            rows, node, tried = rows[~end], node[~end], tried[~end]
        node = left[node] + (columns[tried * np.int64(n) + rows] > cut[node])
    return out


@dataclass
class Tree:
    """What is known of a tree without its nodes."""

    numNodes: int
    depth: int


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for part in ("trees", "shape"):
            self.sparkSession.read.parquet(f"{self.instance.home}/{part}").write.parquet(f"{path}/{part}")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        model, home = ForestModel(), scratch_path(self.sparkSession, "forest")
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        for part in ("trees", "shape"):  # a copy of its own: what is saved there later is another model
            self.sparkSession.read.parquet(f"{path}/{part}").write.parquet(f"{home}/{part}")
        model.home = home
        return model


class ForestModel(
    Model, HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed, MLWritable, MLReadable,
):
    """A grown forest. Its trees are a table; tasks that score hold them packed and unpack one at a time."""

    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth limit of the trees", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows in a leaf", TypeConverters.toInt)
    maxMemoryInMB = Param(Params._dummy(), "maxMemoryInMB", "kept from the classifier", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self.home: str | None = None
        self._packed = None

    @classmethod
    def of(cls, classifier: RandomForestClassifier, home: str) -> ForestModel:
        model = cls()
        model._set(**{p.name: v for p, v in classifier.extractParamMap().items() if model.hasParam(p.name)})
        model.home = home
        return model

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault("numTrees")

    def getMaxDepth(self) -> int:
        return self.getOrDefault("maxDepth")

    def getMaxMemoryInMB(self) -> int:
        return self.getOrDefault("maxMemoryInMB")

    def _table(self, part: str) -> DataFrame:
        return SparkSession.active().read.parquet(f"{self.home}/{part}")

    @property
    def numFeatures(self) -> int:
        return self._table("shape").first()["width"]

    @property
    def trees(self) -> list[Tree]:
        return [Tree(*row) for row in self._table("trees").orderBy("tree").select("size", "depth").collect()]

    @property
    def totalNumNodes(self) -> int:
        return sum(tree.numNodes for tree in self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Gains times weighed rows of all splits by a feature, each tree's scaled to the sum 1, then their sum as well."""
        rows = self._table("trees").orderBy("tree").select("importance").collect()  # one number per tree and feature
        total = sum(_read(bytes(r[0]), np.float64) for r in rows)
        return Vectors.dense(total / (total.sum() or 1.0))

    def _shared(self):
        """The packed trees, sent to the executors once."""
        if self._packed is None:
            spark = SparkSession.active()
            width, edges = self._table("shape").first()
            table = self._table("trees").select("tree", "feature", "bin", "left", "share").toArrow().sort_by("tree")
            trees = list(zip(*[table.column(c).to_pylist() for c in ("feature", "bin", "left", "share")], strict=True))
            self._packed = spark.sparkContext.broadcast((_read(bytes(edges), np.float64).reshape(width, BINS - 1), trees))
        return self._packed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared, count = self._shared(), self.getOrDefault("numTrees")

        def votes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            edges, trees = shared.value
            zero = (edges < 0).sum(axis=1).astype(np.uint8)
            most = max(1, min(SCORED_ROWS, CELLS // len(edges)))
            for places, values in batches:
                found = [np.zeros(0)]
                for low in range(0, len(places), most):
                    p, v = places[low : low + most], values[low : low + most]
                    sizes, flat = np.diff(p.offsets.to_numpy()), p.flatten().to_numpy()
                    bins = _bins(edges, flat, v.flatten().to_numpy())
                    dense = Chunk(np.zeros(len(sizes), np.uint8), sizes, flat, bins).dense(zero)
                    found.append(sum((leaf_shares(dense, tree) for tree in trees), np.zeros(len(sizes))))
                yield pa.array(np.concatenate(found), pa.float64())

        of = F.arrow_udf(votes, "double")
        raw, p, two = self.getRawPredictionCol(), self.getProbabilityCol(), lambda a, b: array_to_vector(F.array(a, b))
        scored = dataset.withColumn("_votes", of(*_entries(self.getFeaturesCol()))).withColumn("_share", F.col("_votes") / count)
        return (
            scored.withColumn(raw, two(count - F.col("_votes"), F.col("_votes")))
            .withColumn(p, two(1.0 - F.col("_share"), F.col("_share")))
            .withColumn(self.getPredictionCol(), (F.col("_share") > 0.5).cast("double"))
            .drop("_votes", "_share")
        )
