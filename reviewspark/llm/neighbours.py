"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and assigns a
vector to the signed axis that it is nearest to: `2 * dimensions` buckets. Every vector is in one bucket of each of `TABLES`
tables. A query probes, in each table, the buckets whose axes are nearest to it (multiprobe); all vectors found there are
compared with it exactly, in double precision, and the best of all tables are the result.

How many buckets a query probes follows from its own neighbours, not from the size of the table. A first search probes
`FIRST_SHARE` of the buckets. The angle to the k-th vector found is an upper bound of the angles to the true neighbours; for
that angle, the chance that a vector lies in the nearest p buckets is known from random pairs, and a second search probes as
many as find such a vector with chance `RECALL` in one table at least. Queries amid near vectors are done after the first.

The tables are meant for angles, the nearness is the Euclidean distance. Where the lengths of vectors differ, all vectors of
a table are lifted to one sphere by one more coordinate, sqrt(R^2 - |x|^2) with R the largest length: vectors that are near
each other are near on that sphere.

A bucket's vectors and queries meet in blocks of at most about `BLOCK` vectors and `ASKS` queries, so a bucket that holds a
third of all vectors is spread over many tasks, and a block gives at most k rows per query. A query that found fewer than k
probes all buckets. So no cap loses a neighbour that was looked at.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part;
vectors of different length are not compared; rows of one id are one candidate at its smallest distance (equal rows are one
row); ties go to the smaller id; fewer candidates than k: all of them; an empty table gives an empty table; other columns do
not matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

TABLES = 8
FIRST_SHARE = 1 / 32
RECALL = 0.98
ANGLES = 64  # steps of half a turn
BLOCK = 8192
ASKS = 512
ROUNDS = 3
ALIKE = 1e-4  # squared lengths that differ by less than this share count as one length


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths; the number of columns is a power of two."""
    n = x.shape[1]
    step = 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of every row, padded with zeros to a power of two."""
    size = 1 << max(1, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng([20240817, size, table]).integers(0, 2, (ROUNDS, size)) * 2.0 - 1
    for row in signs:
        padded = hadamard(padded * row)
    return padded


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """Rows on a sphere of squared radius ``reach`` through one more coordinate, as unit vectors; 0 leaves out the coordinate."""
    if reach:
        more = np.sqrt(np.maximum(0.0, reach - (x * x).sum(1)))
        x = np.concatenate([x, more[:, None]], 1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def buckets(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis of every row: 2 * axis, one more for the negative side."""
    axis = np.abs(turned).argmax(1)
    return (2 * axis + (turned[np.arange(len(turned)), axis] < 0)).astype(np.int32)


def probes(turned: np.ndarray) -> np.ndarray:
    """Per row all signed axes, nearest first."""
    sides = np.stack([turned, -turned], 2).reshape(len(turned), -1)
    return np.argsort(-sides, axis=1, kind="stable").astype(np.int32)


@functools.cache
def probe_counts(dimensions: int, tables: int, recall: float) -> np.ndarray:
    """How many buckets to probe per table, by angle in steps of half a turn / ANGLES, to find a vector at that angle."""
    draw = np.random.default_rng([20240818, dimensions])
    pairs = max(256, (1 << 18) // dimensions)
    q, other = draw.standard_normal((2, pairs, dimensions))
    q = lifted(q, 0.0)
    across = other - (other * q).sum(1)[:, None] * q
    across /= np.maximum(np.sqrt((across * across).sum(1)), 1e-300)[:, None]
    turned, turned_across = rotated(q, tables), rotated(across, tables)
    sides = np.stack([turned, -turned], 2).reshape(pairs, -1)
    each = 1 - (1 - recall) ** (1 / tables)  # chance per table
    counts = []
    for step in range(ANGLES + 1):
        angle = math.pi * step / ANGLES
        at = buckets(math.cos(angle) * turned + math.sin(angle) * turned_across)
        ranks = (sides > sides[np.arange(pairs), at][:, None]).sum(1)
        counts.append(int(np.quantile(ranks, each, method="higher")) + 1)
    return np.maximum.accumulate(counts)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _coded(vectors: DataFrame, tables: int, wanted: tuple[str, float] | None) -> DataFrame:
    """(id, size, reach, vector, codes): the bucket in each table, or the probed buckets, table after table.

    ``vectors``: id, size, reach, vector, and for probes an angle. ``wanted``: ("share", of all buckets) or ("recall", chance
    at the row's angle).
    """
    kind = vectors.schema["vector"].dataType.simpleString()

    def codes(part: pa.RecordBatch, size: int, radius: float) -> Iterator[np.ndarray]:
        unit = lifted(_matrix(part.column(3), size), radius)
        turned = [rotated(unit, table) for table in range(tables)]
        if wanted is None:
            yield from np.stack([buckets(t) for t in turned], 1)
            return
        orders, (how, much) = [probes(t) for t in turned], wanted
        every = orders[0].shape[1]
        if how == "share":
            counts = np.full(len(unit), math.ceil(much * every))
        else:
            steps = np.ceil(part.column(4).to_numpy() * (ANGLES / math.pi)).astype(np.int64)
            table = np.append(probe_counts(unit.shape[1], tables, much), every)  # beyond half a turn: all
            counts = np.minimum(table[np.minimum(steps, ANGLES + 1)], every)
        for i, n in enumerate(counts.tolist()):
            yield np.concatenate([order[i, :n] for order in orders])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, reaches = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for size, radius in sorted(set(zip(sizes.tolist(), reaches.tolist(), strict=True))):
                rows = batch.filter(pa.array(sizes == size))
                for low in range(0, rows.num_rows, 1024):
                    part = rows.slice(low, 1024)
                    found = list(codes(part, size, radius))
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], ["id", "size", "reach", "vector", "codes"])

    columns = ["id", "size", "reach", "vector"] + (["angle"] if wanted and wanted[0] == "recall" else [])
    return vectors.select(*columns).mapInArrow(run, f"id bigint, size int, reach double, vector {kind}, codes array<int>")


def _dealt(coded: DataFrame, tables: int) -> DataFrame:
    """(id, size, reach, vector, tab, bucket): a row per code."""
    rows = coded.select("id", "size", "reach", "vector", F.size("codes").alias("n"), F.posexplode("codes").alias("at", "bucket"))
    return rows.select("id", "size", "reach", "vector", F.expr(f"int(at div (n div {tables}))").alias("tab"), "bucket")


def _nearest(table: pa.Table, k: int) -> pa.Table:
    """One block: the k nearest of its vectors for each of its queries, by exact distances."""
    size = table.column("size")[0].as_py()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, x = table.column("id").to_numpy(), _matrix(table.column("vector").combine_chunks(), size)
    held, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
    radius = table.column("reach")[0].as_py()
    out = [[], [], [], []]
    held_x, held_ids = x[held], ids[held]
    squares = (held_x * held_x).sum(1)
    for low in range(0, len(asked) if len(held) else 0, 64):
        some = asked[low : low + 64]
        rough = squares - 2 * (x[some] @ held_x.T)  # the query's own length does not change the order
        slack = 1e-9 * (squares.max() + (x[some] * x[some]).sum(1).max())
        for i, row in zip(some.tolist(), rough, strict=True):
            others = held_ids != ids[i]
            row = np.where(others, row, np.inf)
            last = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            near = np.flatnonzero(others & (row <= last + slack))
            if len(near) < others.sum() and len(np.unique(held_ids[near])) < k:
                near = np.flatnonzero(others)  # several rows of one id, or squares beyond doubles
            # one sum after the other, as SQL does
            exact = np.sqrt(np.cumsum((held_x[near] - x[i]) ** 2, axis=1)[:, -1])
            best = near[np.lexsort((held_ids[near], exact))]
            exact = np.sort(exact)
            _, first = np.unique(held_ids[best], return_index=True)
            first = np.sort(first)[:k]
            out[0].append(np.full(len(first), ids[i]))
            out[1].append(held_ids[best[first]])
            out[2].append(exact[first])
            cosines = lifted(held_x[best[first]], radius) @ lifted(x[i : i + 1], radius)[0]
            out[3].append(np.nan_to_num(np.arccos(np.clip(cosines, -1, 1)), nan=math.pi))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score", "angle"])


def _met(index: DataFrame, queries: DataFrame, k: int, block: int, asks: int) -> DataFrame:
    """(query_id, vec_id, score, angle): the k nearest per query and block of a bucket. Both as from `_dealt`."""
    place = ["size", "tab", "bucket"]
    held = index.groupBy(*place).agg(F.count("*").alias("n"))
    asked = queries.groupBy(*place).agg(F.count("*").alias("m"))
    sizes = held.join(asked, place).select(*place, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / asks).cast("int").alias("groups"))
    sizes = saved(sizes, "neighbour-buckets")  # a row per table and bucket
    draw = F.xxhash64("id", "vector")
    columns = [*place, "id", "reach", "vector"]
    left = index.join(sizes, place).select(*columns, F.lit(False).alias("asks"), F.pmod(draw, F.col("blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("j"))
    right = queries.join(sizes, place).select(*columns, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(draw, F.col("groups")).cast("int").alias("j"))
    return left.unionByName(right).groupBy(*place, "i", "j").applyInArrow(lambda t: _nearest(t, k), "query_id bigint, vec_id bigint, score double, angle double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank; a task keeps k rows per query before the exchange."""
    once = found.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "angle")).alias("best")).select("query_id", "vec_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    table: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, first_share: float = FIRST_SHARE, recall: float = RECALL, block: int = BLOCK, asks: int = ASKS,
) -> DataFrame:
    """The k nearest other rows of every row where ``asked`` (a condition on ``id``) holds: query_id, rank, vec_id, score."""
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vector = F.col("vector")
    fit = F.size(vector) > 0
    fit &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    fit &= F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False))).distinct()
    rows = saved(rows.withColumn("size", F.size("vector")), "neighbour-vectors")

    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy("size").agg(F.min(square).alias("low"), F.max(square).alias("high"), F.count_distinct("id").alias("n"))
    reach = F.when(F.col("low") < F.col("high") * (1 - ALIKE), F.col("high")).otherwise(F.lit(0.0))
    lengths = saved(lengths.select("size", reach.alias("reach"), "n"), "neighbour-lengths")  # a row per vector length
    rows = rows.join(lengths, "size")

    index = _dealt(saved(_coded(rows, tables, None), "neighbour-index"), tables)
    queries = rows.where(asked)
    probing = _dealt(saved(_coded(queries, tables, ("share", first_share)), "neighbour-probes"), tables)
    found = saved(_best(_met(index, probing, k, block, asks), k), "neighbour-found")

    # the angle to the k-th vector found; beyond half a turn where fewer are found than there are
    seen = found.groupBy("query_id").agg(F.count("*").alias("found"), F.max("angle").alias("angle"))
    far = queries.join(seen, queries["id"] == seen["query_id"], "left")
    enough = F.col("found") >= F.least(F.lit(k), F.col("n") - 1)
    far = far.withColumn("angle", F.coalesce(F.when(enough, F.col("angle")), F.lit(4.0)))
    probing = saved(_coded(far, tables, ("recall", recall)), "neighbour-more-probes")
    probing = probing.where(F.size("codes") > tables * F.ceil(F.lit(first_share) * _buckets(F.col("size"), F.col("reach"))))
    found = _best(found.drop("rank").unionByName(_met(index, _dealt(probing, tables), k, block, asks)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def _buckets(size: Column, reach: Column) -> Column:
    """Buckets of a table: twice the dimensions, filled up to a power of two."""
    dimensions = size + F.when(reach > 0, 1).otherwise(0)
    return 2 * F.pow(F.lit(2), F.greatest(F.lit(1), F.ceil(F.log2(dimensions))))
