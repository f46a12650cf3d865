"""Class balancing of labelled rows: synthetic minority rows, majority cuts, stratified folds.

Rows have an id, a 0/1 label and a feature array or vector. Vectors stay sparse throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import ranked_by_hash

# Default ratios, neighbours of the synthetic rows, seed.
OVERSAMPLING_RATIO, UNDERSAMPLING_RATIO = 0.5, 0.8
NEIGHBOURS = 5
SEED = 42

BLOCK_ROWS = 2048
GROUP_ROWS = 16384  # rows of each side of a task, which meet block by block
GROUPS = 7  # so many groups at least, where there are as many blocks: 28 tasks
PAIRS = 1 << 21  # pairs of entries that are multiplied at once
EXACT_PAIRS = 1 << 13  # pairs of rows whose exact distances are worked out at once
DENSE_SHARE = 512  # columns used by more than one of so many pairs of rows are multiplied as a matrix


@dataclass
class ClassSizes:
    minority: int
    n_min: int
    n_maj: int
    classes: int


def class_sizes(rows: DataFrame, label: str = "label") -> ClassSizes:
    counts = {int(r[label]): r["count"] for r in rows.groupBy(label).count().collect()}
    minority = min(counts, key=lambda c: (counts[c], -c)) if counts else 0
    n_min = counts.get(minority, 0)
    return ClassSizes(minority, n_min, sum(counts.values()) - n_min, len(counts))


class _Sparse:
    """The non-zero entries of some vectors: per row a stretch of (column, value), columns ascending."""

    def __init__(self, rows: pd.DataFrame):
        self.names = rows["id"].to_numpy()
        sizes = rows["columns"].map(len).to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64)
        values = np.concatenate([*rows["values"], np.zeros(0)]).astype(np.float64)
        kept = values != 0
        self.sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        self.ends = np.cumsum(self.sizes)
        self.columns, self.values = np.concatenate([*rows["columns"], np.zeros(0, np.int64)]).astype(np.int64)[kept], values[kept]
        self.squares = np.add.reduceat(np.append(self.values**2, 0.0), self.ends - self.sizes) * (self.sizes > 0)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i] - self.sizes[i], self.ends[i])
        return self.columns[part], self.values[part]


def _products(a: _Sparse, b: _Sparse) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, column by column, over the pairs of rows that both use it.

    Columns that many rows use go through one matrix product; the pairs of the others are met in slices of bounded size.
    """
    out = np.zeros(len(a.names) * len(b.names))
    top = 1 + max(a.columns.max(initial=-1), b.columns.max(initial=-1))
    in_a, in_b = np.bincount(a.columns, minlength=top), np.bincount(b.columns, minlength=top)
    common = in_a * in_b * DENSE_SHARE > len(out)
    heavy = np.flatnonzero(common)
    sides = []
    for side in (a, b):
        owner, rare = np.repeat(np.arange(len(side.names)), side.sizes), ~common[side.columns]
        dense = np.zeros((len(side.names), len(heavy)))
        dense[owner[~rare], np.searchsorted(heavy, side.columns[~rare])] = side.values[~rare]
        sides.append((dense, owner[rare], side.columns[rare], side.values[rare]))
    (left, row, column, value), (right, owner, columns, values) = sides
    order = np.argsort(columns, kind="stable")
    owner, columns, values = owner[order], columns[order], values[order]
    first = np.searchsorted(columns, column)
    sizes = np.searchsorted(columns, column, side="right") - first
    ends = np.cumsum(sizes)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - sizes[low] + PAIRS, side="right")))
        n = sizes[low:high]
        at = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        base = int(row[low]) * len(b.names)  # rows of ``a`` come in order, so a slice adds to a stretch of them
        places = np.repeat(row[low:high] * len(b.names) - base, n) + owner[at]
        sums = np.bincount(places, np.repeat(value[low:high], n) * values[at])
        out[base : base + len(sums)] += sums
        low = high
    return out.reshape(len(a.names), len(b.names)) + left @ right.T


def _squares(a: _Sparse, b: _Sparse) -> np.ndarray:
    """Rough squared distances of all rows of ``a`` to all of ``b``, infinite where the ids are equal."""
    rough = a.squares[:, None] + b.squares[None, :] - 2 * _products(a, b)
    rough[a.names[:, None] == b.names[None, :]] = np.inf
    return rough


def _exact(a: _Sparse, i: np.ndarray, b: _Sparse, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed column by column, so that equal pairs of vectors give equal numbers."""
    keys, values = [], []
    top = 1 + max(a.columns.max(initial=-1), b.columns.max(initial=-1))
    for side, rows, sign in ((a, i, 1.0), (b, j, -1.0)):
        n = side.sizes[rows]
        at = np.repeat(side.ends[rows] - np.cumsum(n), n) + np.arange(int(n.sum()))
        keys.append(np.repeat(np.arange(len(rows)), n) * top + side.columns[at])
        values.append(sign * side.values[at])
    keys, values = np.concatenate(keys), np.concatenate(values)
    if not len(keys):
        return np.zeros(len(i))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    parts, ends = np.add.reduceat(values, first) ** 2, np.searchsorted(keys[first] // top, np.arange(len(i) + 1))
    return np.array([parts[start:end].sum() for start, end in zip(ends[:-1], ends[1:], strict=True)])


def _best_of_block(a: _Sparse, b: _Sparse, k: int, rough: np.ndarray) -> list[tuple[str, str, float]]:
    """Per row of ``a`` its ``k`` nearest rows of ``b`` with another id: by ``rough`` distances first, then the exact ones."""
    found = []
    if not len(a.names) or not len(b.names):
        return found
    last = np.partition(rough, min(k, len(b.names)) - 1, axis=1)[:, min(k, len(b.names)) - 1]
    slack = 1e-9 * (a.squares + b.squares.max() + 1)
    most = np.where(np.isfinite(last), last + slack, np.finfo(float).max)
    i, j = np.nonzero(rough <= most[:, None])
    parts = [_exact(a, i[c : c + EXACT_PAIRS], b, j[c : c + EXACT_PAIRS]) for c in range(0, len(i), EXACT_PAIRS)]
    exact = np.concatenate(parts or [np.zeros(0)])
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for start, end in zip(starts, np.append(starts, len(i))[1:], strict=True):
        met = sorted(zip(exact[start:end].tolist(), b.names[j[start:end]], strict=True))
        found += [(a.names[i[start]], name, distance) for distance, name in met[:k]]
    return found


def nearest_neighbours(points: DataFrame, k: int, n: int, entry_id: str = "id", vector: str = "features") -> DataFrame:
    """The ``k`` nearest other points of every point (id, slot 1..k, neighbour), exact, ties by id.

    Points travel as their non-zero entries and are hashed into groups of about 16384, fewer where there are few. A task
    meets two groups in blocks of 2048, both ways at once, by products of the columns that both use, and keeps the best ``k``
    per point; so neither a task nor its output grows with the table, and a point travels once per group. The number of pairs
    of groups grows with the square of their number.
    """
    groups = max(1, math.ceil(n / GROUP_ROWS), min(GROUPS, math.ceil(n / BLOCK_ROWS)))
    if isinstance(points.schema[vector].dataType, VectorUDT):
        columns, values = _entries(vector)
    else:
        v = F.col(vector).cast("array<double>")
        places = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) != 0)
        columns, values = F.when(F.size(v) > 0, places).otherwise(F.array().cast("array<int>")), F.filter(v, lambda x: x != 0)
    base = points.select(F.col(entry_id).cast("string").alias("id"), columns.alias("columns"), values.alias("values"))
    base = base.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = base.withColumn("other", other).withColumn("i", F.least("group", "other")).withColumn("j", F.greatest("group", "other"))
    block = BLOCK_ROWS

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cut = lambda side: [_Sparse(side[low : low + block]) for low in range(0, len(side), block)]
        first = cut(rows[rows["group"] == key[0]])
        second = first if key[0] == key[1] else cut(rows[rows["group"] == key[1]])
        found = []
        for at, a in enumerate(first):
            for b in second[at:] if second is first else second:
                rough = _squares(a, b)
                found += _best_of_block(a, b, k, rough)
                if b is not a:
                    found += _best_of_block(b, a, k, rough.T)
        best = pd.DataFrame(found, columns=["id", "neighbour", "distance"]).sort_values(["id", "distance", "neighbour"])
        return best.groupby("id", sort=False).head(k)

    candidates = dealt.groupBy("i", "j").applyInPandas(compare, "id string, neighbour string, distance double")
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (
        candidates.withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= k)
        .select("id", "slot", "neighbour")
    )


def _entries(vector: str) -> tuple[Column, Column]:
    """Places and values of a vector's stored entries; dense vectors hold a value in every place."""
    parts = F.unwrap_udt(F.col(vector))
    return F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1)), parts["values"]


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _between(a: str, b: str, gap: str) -> Column:
    """The point at the share ``gap`` of the line from the vector ``a`` to ``b``, as a sparse vector."""

    def points(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]],
    ) -> Iterator[pa.Array]:
        for of_a, in_a, of_b, in_b, sizes, gaps in batches:
            n, size = len(sizes), sizes.to_numpy()
            width = int(size.max()) if n else 1
            keys, values = [], []
            for places, entries in ((of_a, in_a), (of_b, in_b)):
                row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
                keys.append(row * width + places.flatten().to_numpy())
                values.append(entries.flatten().to_numpy())
            met = np.union1d(*keys)
            start, end = np.zeros(len(met)), np.zeros(len(met))
            for side, key, value in zip((start, end), keys, values, strict=True):
                side[np.searchsorted(met, key)] = value
            row, place = np.divmod(met, width)
            value = start + gaps.to_numpy()[row] * (end - start)
            row, place, value = row[value != 0], place[value != 0], value[value != 0]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((place, pa.int32()), (value, pa.float64()))]
            yield pa.StructArray.from_arrays([pa.array(np.zeros(n), pa.int8()), pa.array(size, pa.int32()), *lists], fields=list(_SPARSE))

    length = F.coalesce(F.unwrap_udt(F.col(a))["size"], F.size(F.unwrap_udt(F.col(a))["values"]))
    return F.arrow_udf(points, VectorUDT())(*_entries(a), *_entries(b), length, F.col(gap))


def _unit(*parts) -> Column:
    """A seeded number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _numbers(rows: DataFrame) -> Column:
    """The features: vectors as they are, arrays of any numbers as doubles."""
    return F.col("features") if isinstance(rows.schema["features"].dataType, VectorUDT) else F.col("features").cast("array<double>")


def synthetic_rows(minority_rows: DataFrame, n_min: int, n_new: int, k: int, seed: int = SEED) -> DataFrame:
    """``n_new`` rows, each on the line between a minority row and one of its ``k`` nearest (Chawla et al. 2002)."""
    spark = minority_rows.sparkSession
    points = minority_rows.select(F.col("id").cast("string").alias("id"), _numbers(minority_rows).alias("features"))
    ranked = ranked_by_hash(points.withColumn("all", F.lit(1)), ["all"], "id", seed).drop("all")
    picks = spark.range(n_new).select(
        F.col("id").alias("pick"),
        (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_min)) + 1).alias("rank"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(k)) + 1).cast("int").alias("slot"),
        _unit(F.lit(seed + 2), "id").alias("gap"),
    )
    near = nearest_neighbours(points, k, n_min)
    ends = points.select(F.col("id").alias("neighbour"), F.col("features").alias("end"))
    if isinstance(points.schema["features"].dataType, VectorUDT):
        made = _between("features", "end", "gap")
    else:
        made = F.zip_with("features", "end", lambda a, b: a + F.col("gap") * (b - a))
    return (
        picks.join(ranked, "rank")
        .join(near, ["id", "slot"])
        .join(ends, "neighbour")
        .select(
            F.concat(F.lit("synthetic_"), F.col("pick").cast("string")).alias("id"),
            made.alias("features"),
            F.col("id").alias("from_id"),
            "neighbour",
        )
    )


def oversample(
    rows: DataFrame, ratio: float = OVERSAMPLING_RATIO, seed: int = SEED, sizes: ClassSizes | None = None
) -> DataFrame:
    """Raise the minority class to ``ratio`` times the majority; unchanged when it is already that large."""
    sizes = sizes or class_sizes(rows)
    n_new = int(ratio * sizes.n_maj) - sizes.n_min
    if n_new <= 0:
        return rows
    k = min(NEIGHBOURS, sizes.n_min - 1)
    made = synthetic_rows(rows.filter(F.col("label") == sizes.minority), sizes.n_min, n_new, k, seed)
    made = made.select(
        "id", F.lit(sizes.minority).cast(rows.schema["label"].dataType).alias("label"), "features"
    )
    same_type = rows.select(
        F.col("id").cast("string").alias("id"), "label", _numbers(rows).alias("features")
    )
    return same_type.unionByName(made)


def undersample(
    rows: DataFrame,
    ratio: float = UNDERSAMPLING_RATIO,
    seed: int = SEED,
    sizes: ClassSizes | None = None,
    entry_id: str = "id",
) -> DataFrame:
    """Cut the majority class to the minority size over ``ratio`` by seeded random choice."""
    sizes = sizes or class_sizes(rows)
    keep = int(sizes.n_min / ratio)
    if keep > sizes.n_maj:
        raise ValueError("the majority class is smaller than the ratio asks for")
    ranked = ranked_by_hash(rows, ["label"], entry_id, seed, "_rank")
    return ranked.filter((F.col("label") == sizes.minority) | (F.col("_rank") <= keep)).drop("_rank")


def resample(
    rows: DataFrame,
    strategy: str = "combined",
    oversampling_ratio: float = OVERSAMPLING_RATIO,
    undersampling_ratio: float = UNDERSAMPLING_RATIO,
    seed: int = SEED,
) -> DataFrame:
    """Balance by 'over', 'under' or 'combined'; data too small for it comes back as it was.

    The combined strategy returns the original rows when the cut after oversampling is impossible.
    """
    sizes = class_sizes(rows)
    if sizes.classes < 2 or sizes.n_min < 2:
        return rows
    if strategy == "over":
        return oversample(rows, oversampling_ratio, seed, sizes)
    if strategy == "under":
        return undersample(rows, undersampling_ratio, seed, sizes)
    grown_min = max(sizes.n_min, int(oversampling_ratio * sizes.n_maj))
    if int(grown_min / undersampling_ratio) > sizes.n_maj:
        return rows
    grown = oversample(rows, oversampling_ratio, seed, sizes)
    return undersample(
        grown, undersampling_ratio, seed, ClassSizes(sizes.minority, grown_min, sizes.n_maj, sizes.classes)
    )


def stratified_folds(
    rows: DataFrame, n_folds: int = 5, seed: int = SEED, entry_id: str = "entry_id", n: int | None = None
) -> DataFrame:
    """Add ``fold``: every label is dealt out evenly over min(n_folds, rows) folds in seeded random order."""
    k = max(1, min(n_folds, rows.count() if n is None else n))
    ranked = ranked_by_hash(rows, ["label"], entry_id, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
