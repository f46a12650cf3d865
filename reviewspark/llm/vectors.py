"""Near-duplicate vectors by sorted projection passes.

Each pass draws its own random hyperplanes; a vector's key is the string of its sides, most significant first. All passes
are sorted together by (pass, key), and every vector is compared exactly with the next `WINDOW` vectors of its pass in its task (a window ends where the task's
range ends). Links
that join two vectors not yet joined inside the task are kept, so a pass gives fewer links than vectors however dense the
data is; the links of all passes are united into components.

The passes are the quick way to most links, not the bound of the result, which does not depend on ranges or partitions. A sweep then compares the vectors of different
components, so that no link is lost: vectors go to the cell of the nearest of about one in `PER_CELL` of them, cells are
put together to chunks of `CHUNK_BYTES`, and every chunk is compared with all vectors of its own and later chunks, cell by
cell. By the triangle inequality a vector cannot link into a cell whose vector is farther away than the cell's radius and
the threshold angle together, so far cells are passed over; all other pairs are compared. On vectors without clusters no
cell is far, and the sweep is quadratic in the number of classes; its memory and disk are not.

Inside each component all pairs are then counted, in blocks of `BLOCK` vectors that no single task has to hold together.
For large components a centre saves most of that: vectors within half the threshold angle of it are linked to one another
without a comparison, so only the others are compared with all.

Gathered on the driver: the cell vectors (one in `PER_CELL`, and one per length of vectors), a number and a radius per
cell, and one chunk at a time, which is broadcast.

Equal vectors are one class and carry their number; classes are compared, not copies.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with nothing (n_links 0, own
component, kept); vectors of different length never link; repeated rows are vectors of their own; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import saved
from .words import mixed

PASSES = 12
BITS = 48
WINDOW = 32
BLOCK = 1024
PER_CELL = 1024
CHUNK_BYTES = 32 << 20


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(1))[:, None]


def _stacked(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def hyperplanes(size: int, pass_no: int, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([20240611, size, pass_no]).standard_normal((size, bits))


def _keys(classes: DataFrame, passes: int, bits: int) -> DataFrame:
    """(pass, size, key, salt, node, vector) for every pass."""
    powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, rows in frame.groupby("size"):
                unit = _stacked(rows["vector"])
                for p in range(passes):
                    key = (unit @ hyperplanes(int(size), p, bits) > 0) @ powers
                    salt = (rows["node"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    yield pd.DataFrame({"pass": p, "size": size, "key": key, "salt": salt, "node": rows["node"], "vector": rows["vector"]})

    return classes.mapInPandas(run, "pass int, size int, key bigint, salt bigint, node bigint, vector array<double>")


def _window_links(keys: DataFrame, cosine: float, window: int) -> DataFrame:
    """Verified links (a, b) between neighbours of a pass."""
    order = ["pass", "size", "key", "salt", "node"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "size", "node", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, current = graph.Forest(), None
        nodes, unit = np.zeros(0, np.int64), None
        for batch in batches:
            frame = batch.to_pandas()
            a, b = [], []
            for group, rows in frame.groupby(["pass", "size"], sort=True):
                if group != current:  # a pass of the table begins
                    forest, current, nodes, unit = graph.Forest(), group, np.zeros(0, np.int64), None
                fresh = _stacked(rows["vector"])
                old = len(nodes)
                nodes = np.concatenate([nodes, rows["node"].to_numpy(np.int64)])
                unit = fresh if unit is None else np.concatenate([unit, fresh])
                for shift in range(1, min(window, len(nodes) - 1) + 1):
                    first = max(0, old - shift)  # pairs whose later vector is new
                    near = np.einsum("ij,ij->i", unit[first : len(nodes) - shift], unit[first + shift :]) >= cosine
                    for i in (np.flatnonzero(near) + first).tolist():
                        x, y = int(nodes[i]), int(nodes[i + shift])
                        if forest.join(x, y):
                            a.append(x)
                            b.append(y)
                nodes, unit = nodes[-window:], unit[-window:]
                kept = set(nodes.tolist())
                roots = {x: forest.find(x) for x in kept}
                forest = graph.Forest()  # what has left the window is forgotten; its links are out already
                heads: dict[int, int] = {}
                for x, root in roots.items():
                    forest.join(x, heads.setdefault(root, x))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _fetched(table: DataFrame) -> pd.DataFrame:
    return table.toArrow().to_pandas()


def _cells(classes: DataFrame, per_cell: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """By vector length: the unit vectors that cells are around, and the number of the first cell."""
    draw = F.xxhash64("node")
    lowest = classes.groupBy("size").agg(F.min_by("node", draw).alias("node")).select("node")
    some = classes.select("node").where(F.pmod(draw, F.lit(per_cell)) == 0).union(lowest).distinct()
    rows = _fetched(classes.join(some, "node", "left_semi").select("size", "node", "vector")).sort_values(["size", "node"])
    around, first = {}, {}
    for size, part in rows.groupby("size"):
        first[int(size)] = sum(map(len, around.values()))
        around[int(size)] = _stacked(part["vector"])
    return around, first


def _in_chunks(classes: DataFrame, around: dict[int, np.ndarray], first: dict[int, int], chunk_bytes: int) -> tuple[DataFrame, np.ndarray, int]:
    """(rows with cell and chunk, dealt by chunk; radius of every cell; number of chunks)."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((around, first))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around, first = shared.value
        for frame in frames:
            for size, rows in frame.groupby("size"):
                cosines = _stacked(rows["vector"]) @ around[int(size)].T
                nearest = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(rows)), nearest], -1, 1))
                yield pd.DataFrame({"node": rows["node"], "component": rows["component"], "size": size, "vector": rows["vector"], "cell": nearest + first[int(size)], "angle": angle})

    kind = "node bigint, component bigint, size int, vector array<double>, cell int, angle double"
    placed = saved(classes.select("node", "component", "size", "vector").mapInPandas(place, kind), "vector-cells")
    cells = _fetched(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("size").alias("size"))).sort_values("cell")
    radius = np.zeros(sum(map(len, around.values())))
    radius[cells["cell"].to_numpy()] = cells["radius"].to_numpy()
    start, parts = np.zeros(len(radius), np.int64), np.ones(len(radius), np.int64)
    at, room = -1, 0
    for cell, n, size in zip(cells["cell"], cells["n"], cells["size"], strict=True):
        need = n * (8 * size + 64)
        parts[cell] = max(1, -(-need // chunk_bytes))
        if need > room:  # a cell beyond a chunk gets chunks of its own
            at, room = at + 1, chunk_bytes
        start[cell] = at
        at, room = at + int(parts[cell]) - 1, room - need
    numbers = spark.sparkContext.broadcast((start, parts))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, parts = numbers.value
        for batch in batches:
            cell, node = (batch.column(x).to_numpy() for x in ("cell", "node"))
            part = mixed(node.astype(np.uint64)) % parts[cell].astype(np.uint64)
            columns = [*(batch.column(x) for x in ("node", "component", "size", "vector", "cell")), pa.array(start[cell] + part.astype(np.int64), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "component", "size", "vector", "cell", "chunk"])

    numbered = placed.mapInArrow(number, "node bigint, component bigint, size int, vector array<double>, cell int, chunk int")
    dealt = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk", "cell", "node")
    return saved(dealt.sortWithinPartitions("chunk", "cell", "node"), "vector-chunks"), radius, at + 1


def _sweep(classes: DataFrame, cosine: float, per_cell: int, chunk_bytes: int) -> DataFrame:
    """Links (a, b) that join different components: of all linked pairs, at least as many as connect what they connect.

    ``classes``: node, component, size, vector.
    """
    spark = classes.sparkSession
    around, first = _cells(classes, per_cell)
    placed, radius, chunks = _in_chunks(classes, around, first, chunk_bytes)
    reach = math.acos(min(1.0, max(-1.0, cosine))) + 1e-6
    found = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for chunk in range(chunks):
        part = _fetched(placed.where(F.col("chunk") == chunk).select("node", "component", "size", "vector", "cell")).sort_values(["cell", "node"])
        held = []  # per cell: its number, the vector it is around, its nodes, components and unit vectors
        for (size, cell), rows in part.groupby(["size", "cell"]):
            held.append((int(size), int(cell), around[int(size)][int(cell) - first[int(size)]], rows["node"].to_numpy(np.int64), rows["component"].to_numpy(np.int64), _stacked(rows["vector"])))
        shared = spark.sparkContext.broadcast((held, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, radius = shared.value  # noqa: B023 - the job ends before the next chunk
            forest, by_size = graph.Forest(), {}
            for size, *cell in held:
                by_size.setdefault(size, []).append(cell)
            labels = {cell: components.copy() for _, cell, _, _, components, _ in held}
            narrow = {cell: unit.astype(np.float32) for _, cell, _, _, _, unit in held}
            for batch in batches:
                a, b = [], []
                for size, rows in batch.to_pandas().groupby("size"):
                    cells = by_size.get(int(size), [])
                    if not cells:
                        continue
                    nodes, components, unit = rows["node"].to_numpy(np.int64), rows["component"].to_numpy(np.int64), _stacked(rows["vector"])
                    unit32, slack = unit.astype(np.float32), (size + 8) * 2.0**-23
                    angles = np.arccos(np.clip(unit @ np.stack([cell[1] for cell in cells]).T, -1, 1))
                    for k, (cell, _, cell_nodes, _, cell_unit) in enumerate(cells):
                        may = np.flatnonzero(angles[:, k] <= radius[cell] + reach)
                        label = labels[cell]
                        for low in range(0, len(may), 512):
                            some = may[low : low + 512]
                            for left in range(0, len(label), 4096):
                                hits = unit32[some] @ narrow[cell][left : left + 4096].T >= cosine - slack
                                asks = np.flatnonzero(hits.any(1))
                                owns = np.array([forest.find(x) for x in components[some[asks]].tolist()], np.int64)
                                asks = asks[(hits[asks] & (label[left : left + 4096] != owns[:, None])).any(1)]
                                for i in asks.tolist():
                                    x = int(some[i])
                                    own = forest.find(int(components[x]))
                                    other = np.flatnonzero(hits[i]) + left
                                    other = other[label[other] != own]
                                    if not len(other):
                                        continue
                                    other = other[cell_unit[other] @ unit[x] >= cosine]
                                    for root, at in zip(*np.unique(label[other], return_index=True), strict=True):
                                        y = int(other[at])
                                        if forest.join(int(components[x]), int(root)):
                                            a.append(int(nodes[x]))
                                            b.append(int(cell_nodes[y]))
                                        label[label == root] = forest.find(int(root))
                                    label[label == own] = forest.find(own)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        later = placed.where(F.col("chunk") >= chunk).select("node", "component", "size", "vector")
        found = found.union(saved(later.mapInArrow(run, "a bigint, b bigint"), "vector-sweep"))
        shared.destroy()
    return found.distinct()


def _block_counts(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, links): copies linked to a class inside its component, its own copies excepted. Exact."""
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    members = members.join(sizes, "component")
    small = members.where(F.col("members") <= block)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        unit = _stacked(frame["vector"])
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        return pd.DataFrame({"node": frame["node"], "links": near @ frame["copies"].to_numpy(np.int64)})

    counted = small.groupBy("component").applyInPandas(whole, "node bigint, links bigint")

    large = saved(members.where(F.col("members") > block), "vector-large")
    places = F.posexplode("vector").alias("place", "x")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sums = large.select("component", norm.alias("norm"), places).groupBy("component", "place").agg(F.avg(F.col("x") / F.col("norm")).alias("x"))
    centres = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("centre"))
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("vector", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    split = large.join(centres, "component").withColumn("tight", F.coalesce(dot / norm / length > half, F.lit(False))).drop("centre")
    loose_size = F.sum(F.when(~F.col("tight"), 1).otherwise(0))
    totals = split.groupBy("component").agg(loose_size.alias("loose"), F.sum(F.when(F.col("tight"), F.col("copies")).otherwise(0)).alias("tight_copies"))
    split = saved(split.join(totals, "component"), "vector-split")
    among_tight = split.where("tight").select("node", (F.col("tight_copies") - F.col("copies")).alias("links"))
    loose_blocks, all_blocks = F.ceil(F.col("loose") / block).cast("int"), F.ceil(F.col("members") / block).cast("int")
    draw = F.xxhash64("node")
    columns = ["component", "node", "vector", "copies", "tight"]
    every = split.where("loose > 0").select(*columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), loose_blocks - 1)).alias("i"), F.pmod(draw, all_blocks).cast("int").alias("j"))
    asking = split.where(~F.col("tight")).select(*columns, F.lit(True).alias("asks"), F.pmod(draw, loose_blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"))

    def between(frame: pd.DataFrame) -> pd.DataFrame:
        asks, rest = frame[frame["asks"]], frame[~frame["asks"]]
        if not len(asks) or not len(rest):
            return pd.DataFrame({"node": [], "links": []})
        near = _stacked(asks["vector"]) @ _stacked(rest["vector"]).T >= cosine
        near &= asks["node"].to_numpy()[:, None] != rest["node"].to_numpy()[None, :]
        # loose vectors count all others; tight ones count the loose ones that reach them
        tight = rest["tight"].to_numpy(bool)
        back = (asks["copies"].to_numpy(np.int64) @ near)[tight]
        return pd.DataFrame({"node": np.concatenate([asks["node"], rest["node"][tight]]), "links": np.concatenate([near @ rest["copies"].to_numpy(np.int64), back])})

    blocks = every.unionByName(asking).groupBy("component", "i", "j").applyInPandas(between, "node bigint, links bigint")
    return counted.union(among_tight).union(blocks).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    passes: int = PASSES, window: int = WINDOW, bits: int = BITS, block: int = BLOCK,
    per_cell: int = PER_CELL, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    vector = F.col("vector")
    fit = F.size(vector) > 0
    fit &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    fit &= F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)) & F.col("id").isNotNull())
    classes = rows.where("fit").groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("size", F.size("vector")), "vector-classes")
    links = _window_links(_keys(classes, passes, bits), cosine, window)
    links = saved(links, "vector-links")
    groups = saved(graph.components(links), "vector-groups")
    labelled = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = saved(_sweep(labelled, cosine, per_cell, chunk_bytes), "vector-more-links")
    if more.take(1):
        groups = saved(graph.components(links.union(more)), "vector-groups")
    members = classes.join(groups, "node")
    counts = _block_counts(members, cosine, block)
    found = classes.join(groups, "node", "left").join(counts, "node", "left")
    found = found.select("vector", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    fit_rows = rows.where("fit").select("id", "vector").join(found, "vector").select("id", "n_links", "component")
    lone = rows.where(~F.col("fit")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    out = fit_rows.union(lone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
