"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: words, and runs of one to three word shapes (letters by case, digits and other characters
with runs collapsed; a word that repeats the one before has a shape of its own). Each indicator is scaled by the log ratio
of its smoothed frequencies in both classes; a linear hinge-loss model on the scaled indicators, brought to unit length,
is fitted by dual coordinate descent. Its margin becomes a probability by a logistic curve that is fitted on margins of
rows left out in turn (`FOLDS`).

The model is fitted on at most `train_rows` labelled rows (those with the smallest hash of their id), which is the documented
bound of this operator: the rows are featurised where they lie and meet in one task as lists of numbers. The weights, `DIMENSIONS`
numbers whatever the input, go to every scoring task; scoring is one narrow pass over all whole texts.

Defined results: null or empty text has only the bias feature; documents with several labels take the lowest; null labels do
not count; with fewer than `FOLDS` labels of a class every score is the share of label 1 (0.5 without any); a null id is never held
out; repeated rows have equal scores; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import whole_text
from .words import hashes, mixed

DIMENSIONS = 1 << 18
TRAIN_ROWS = 12_000
PASSES = 12
FOLDS = 3
COST = 1.0
SMOOTHING = 1.0
_STEP = np.uint64(0x9FB21C651E98DF25)


def _kind_table() -> np.ndarray:
    kinds = np.arange(256, dtype=np.uint8)
    kinds[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
    kinds[0x41:0x5B] = ord("A")
    kinds[0x30:0x3A] = ord("0")
    return kinds


_KINDS = _kind_table()
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def features(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct feature numbers; number 0 is the bias."""
    for a, b in chunks(texts, 1 << 20):
        raw = [t.encode("utf-8", "replace") + b" " for t in texts[a:b]]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        blank = _BLANK[data]
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
        bounds = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
        owner = np.repeat(np.arange(len(raw)), np.diff(bounds))
        words = hashes(_LOWER[data], starts, ends)
        kinds = _KINDS[data]
        keep = np.append(True, kinds[1:] != kinds[:-1])
        keep[starts] = True
        place = np.cumsum(keep) - keep
        shapes = hashes(kinds[keep], place[starts], place[ends - 1] + keep[ends - 1])
        inner = np.append(False, owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
        again = inner & np.append(False, words[1:] == words[:-1]) if len(owner) else inner
        shapes = np.where(again, np.uint64(7), shapes)
        found, rows = [mixed(words + np.uint64(11)), mixed(shapes + np.uint64(12))], [owner, owner]
        run = shapes
        for n in (2, 3):
            if len(run) > 1:
                run = mixed(run[:-1] * _STEP + shapes[n - 1 :] + np.uint64(n))
                same = owner[n - 1 :] == owner[: len(owner) - n + 1]
                found.append(run[same])
                rows.append(owner[: len(owner) - n + 1][same])
        numbers = (np.concatenate(found) >> np.uint64(20)).astype(np.int64) % (DIMENSIONS - 1) + 1
        keyed = np.unique(np.concatenate([np.concatenate(rows) * DIMENSIONS + numbers, np.arange(len(raw)) * DIMENSIONS]))
        cuts = np.searchsorted(keyed, np.arange(1, len(raw)) * DIMENSIONS)
        yield from np.split(keyed % DIMENSIONS, cuts)


def log_ratios(rows: Sequence[np.ndarray], labels: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of every feature's smoothed share of the documents of class 1 to that of class 0; the bias has 1."""
    counts = [np.full(DIMENSIONS, smoothing), np.full(DIMENSIONS, smoothing)]
    for row, label in zip(rows, labels, strict=True):
        counts[int(label)][row] += 1
    sizes = [2 * smoothing + (labels == k).sum() for k in (0, 1)]
    ratios = np.log(counts[1] / sizes[1]) - np.log(counts[0] / sizes[0])
    ratios[0] = 1.0
    return ratios


def dual_descent(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], signs: np.ndarray, costs: np.ndarray, passes: int) -> np.ndarray:
    """Weights of the linear hinge-loss model: one dual variable at a time moves to its best place between 0 and its cost."""
    weights, dual = np.zeros(DIMENSIONS), np.zeros(len(rows))
    squares = np.array([float(v @ v) for v in values])
    draw = np.random.default_rng(5)
    for _ in range(passes):
        most = 0.0
        for i in draw.permutation(len(rows)):
            if squares[i] == 0:
                continue
            slope = signs[i] * float(weights[rows[i]] @ values[i]) - 1
            moved = min(max(dual[i] - slope / squares[i], 0.0), costs[i])
            change = moved - dual[i]
            if change:
                weights[rows[i]] += change * signs[i] * values[i]
                dual[i] = moved
                most = max(most, abs(change))
        if most < 1e-4:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps on slightly smoothed labels."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    goals = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (p - goals) + 1e-3 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def scaled(rows: Sequence[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    out = []
    for row in rows:
        v = ratios[row]
        out.append(v / max(np.sqrt(v @ v), 1e-12))
    return out


def _support_vectors(rows: Sequence[np.ndarray], labels: np.ndarray, passes: int, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(log ratios, weights); both classes weigh the same in total."""
    ratios = log_ratios(rows, labels)
    signs = np.where(labels == 1, 1.0, -1.0)
    balance = np.where(signs > 0, len(signs) / (2 * (signs > 0).sum()), len(signs) / (2 * (signs < 0).sum()))
    return ratios, dual_descent(rows, scaled(rows, ratios), signs, cost * balance, passes)


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES, cost: float = COST) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(log ratios, weights, slope, offset). The logistic curve sees margins of models that did not learn from the row."""
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    fold = np.zeros(len(rows), np.int64)
    for label in (0, 1):  # every fold has its part of each class
        own = np.flatnonzero(labels == label)
        fold[own] = np.arange(len(own)) % FOLDS
    if min((labels == k).sum() for k in (0, 1)) < FOLDS:
        return np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, float(np.log(share / (1 - share)))
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        out = np.flatnonzero(fold == k)
        ratios, weights = _support_vectors([rows[i] for i in np.flatnonzero(fold != k)], labels[fold != k], passes, cost)
        held = [rows[i] for i in out]
        margins[out] = [float(weights[r] @ v) for r, v in zip(held, scaled(held, ratios), strict=True)]
    return *_support_vectors(rows, labels, passes, cost), *logistic_curve(margins, labels)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Fit on at most ``train_rows`` labelled rows that are not held out. Returns the model as one row of numbers."""
    allowed = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    allowed = allowed.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = allowed.orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [f.astype(np.int32) for f in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["id", "label", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    featured = rows.select("id", "text", "label").mapInArrow(featurise, f"id {kind}, label int, features array<int>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, labels, ids = [], [], []
        for batch in batches:
            ids += [str(x) for x in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
            lists += [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.column(2)]
        order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i], labels[i], len(lists[i])))
        order = np.random.default_rng(3).permutation(np.array(order, np.int64)) if order else []
        ratios, weights, slope, offset = fit([lists[i] for i in order], np.array([labels[i] for i in order], np.int64))
        # margins use weight times ratio, lengths use the ratio alone
        both = np.stack([ratios, weights * ratios]).astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([both], pa.binary()), pa.array([slope]), pa.array([offset])], ["weights", "slope", "offset"])

    # a shuffle of numbers: the rows are found and featurised in parallel, only the fit is one task
    return featured.repartition(1).mapInArrow(learn, "weights binary, slope double, offset double").first()


def scorer(model) -> Callable[[Sequence[str]], np.ndarray]:
    ratios, products = np.frombuffer(model["weights"], "<f8").reshape(2, DIMENSIONS)
    squares = ratios * ratios
    slope, offset = model["slope"], model["offset"]

    def score(texts: Sequence[str]) -> np.ndarray:
        margins = np.array([products[f].sum() / max(np.sqrt(squares[f].sum()), 1e-12) for f in features(texts)])
        return 1 / (1 + np.exp(-np.clip(slope * margins + offset, -35, 35)))

    return score


def score_documents(docs: DataFrame, model, columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and score, the probability of label 1. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model.asDict())
    columns = list(columns)
    with_text = columns if text_col in columns else [*columns, text_col]
    at = with_text.index(text_col)
    source = docs.select(*with_text)
    schema = source.select(*columns).schema.add("score", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            texts = ["" if t is None else str(t) for t in batch.column(at).to_pylist()]
            arrays = [*batch.columns[: len(columns)], pa.array(score(texts) if texts else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = train(docs, labels, train_rows, id_col, text_col)
    scored = score_documents(docs, model, [id_col], text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
