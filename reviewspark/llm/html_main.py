"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes its sequence of leaf blocks (`dom`). A block's features are the tags above it, the words of their class, id
and role, and properties of its text and place; a label (article or not) also depends on the one before. Weights are the
maximum of the regularised likelihood of labelled pages, by stochastic gradient over pages with the forward-backward
recursions; decoding is Viterbi. The model is fitted once on the driver from a fixed number of pages (`TRAIN_PAGES`) and has one
weight per known feature; extraction is one narrow pass.

Defined results: null or empty html gives an empty text; text outside any tag is a block like others; repeated rows give
repeated rows; an empty table gives an empty table; other columns do not matter. White space inside a block, `<br>`
included, becomes one space.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .labelled import labelled_pages

TRAIN_PAGES = 1200
EPOCHS = 6
RATE = 0.3
DECAY = 1e-5


def block_features(blocks: Sequence[dom.Block]) -> list[list[str]]:
    """Feature names of every block of a page."""
    n = len(blocks)
    titles = {b.text for b in blocks if "title" in b.tags}
    out = []
    for k, b in enumerate(blocks):
        words = b.text.split()
        chars = len(b.text)
        letters = sum(map(len, words))
        linked = b.link_chars / max(1, letters)
        own = b.tags[-1] if b.tags else "none"
        names = [f"above:{t}" for t in set(b.tags)] + [f"own:{own}", f"name:{len(b.names) > 0}"]
        names += [f"word:{w}" for w in b.names] + [f"near:{w}" for w in b.parent_names]
        if own != "title" and b.text in titles:
            names.append(f"title:{own}")
        names += [
            "bias", f"length:{min(10, int(math.log2(chars + 1)))}", f"words:{min(6, int(math.log2(len(words) + 1)))}", f"linked:{int(linked * 4)}",
            f"ends:{b.text[-1] in '.!?:;'}", f"commas:{min(3, b.text.count(','))}", f"mark:{b.text[0] in '©®'}", f"emphasis:{b.emphasis}",
            f"place:{int(5 * k / n)}", f"depth:{min(8, len(b.tags))}",
        ]
        out.append(names)
    return out


class ChainModel:
    """Binary chain: `weights` score label 1 against 0 per feature, `steps` score label pairs, `start` the first label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.steps, self.start = index, weights, steps, start

    def scores(self, features: list[list[str]]) -> list[float]:
        index, weights = self.index, self.weights
        return [float(sum(weights[index[f]] for f in names if f in index)) for names in features]

    def decode(self, scores: Sequence[float]) -> list[int]:
        """Viterbi: the likeliest sequence of labels."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for score in scores[1:]:
            from_zero, from_one = zero + s00 >= one + s10, zero + s01 >= one + s11
            back.append((0 if from_zero else 1, 0 if from_one else 1))
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + score
        labels = [int(one > zero)]
        for choices in reversed(back):
            labels.append(choices[labels[-1]])
        return labels[::-1]


def _marginals(scores: np.ndarray, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of label 1 per block, and summed probabilities of label pairs, by forward-backward."""
    n = len(scores)
    emit = np.zeros((n, 2))
    emit[:, 1] = scores
    grow = np.exp(steps - steps.max())
    emit = np.exp(emit - emit.max(1)[:, None])
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = np.exp(start - start.max()) * emit[0]
    ahead[0] /= ahead[0].sum()
    for k in range(1, n):
        ahead[k] = (ahead[k - 1] @ grow) * emit[k]
        ahead[k] /= ahead[k].sum()
    pairs = np.zeros((2, 2))
    for k in range(n - 1, 0, -1):
        joint = ahead[k - 1][:, None] * grow * (emit[k] * behind[k])[None, :]
        pairs += joint / joint.sum()
        behind[k - 1] = grow @ (emit[k] * behind[k])
        behind[k - 1] /= behind[k - 1].sum()
    both = ahead * behind
    return both[:, 1] / both.sum(1), pairs


def fit(pages: Sequence[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> ChainModel:
    """Maximise the likelihood of labelled sequences by adaptive gradient steps, one page at a time."""
    counts: dict[str, int] = {}
    for features, _ in pages:
        for names in features:
            for f in names:
                counts[f] = counts.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    weights, seen = np.zeros(len(index)), np.full(len(index), 1e-2)
    steps, steps_seen, start, start_seen = np.zeros((2, 2)), np.full((2, 2), 1e-2), np.zeros(2), np.full(2, 1e-2)
    rows = []
    for features, labels in pages:
        flat = [(k, index[f]) for k, names in enumerate(features) for f in names if f in index]
        rows.append((np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), np.array(labels, float)))
    draw = random.Random(seed)
    for _ in range(epochs):
        for p in draw.sample(range(len(rows)), len(rows)):
            block, feature, labels = rows[p]
            scores = np.bincount(block, weights[feature], len(labels))
            ones, pairs = _marginals(scores, steps, start)
            gradient = np.bincount(feature, (labels - ones)[block], len(index)) - DECAY * weights
            seen += gradient * gradient
            weights += rate * gradient / np.sqrt(seen)
            actual = np.zeros((2, 2))
            np.add.at(actual, (labels[:-1].astype(int), labels[1:].astype(int)), 1)
            step = actual - pairs - DECAY * steps
            steps_seen += step * step
            steps += rate * step / np.sqrt(steps_seen)
            first = np.array([1 - labels[0], labels[0]]) - np.array([1 - ones[0], ones[0]])
            start_seen += first * first
            start += rate * first / np.sqrt(start_seen)
    return ChainModel(index, weights, steps, start)


@functools.cache
def trained(count: int = TRAIN_PAGES, seed: int = 7) -> ChainModel:
    pages = []
    for page, labels in labelled_pages(count, seed):
        blocks = dom.leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page does not fall into its blocks")
        pages.append((block_features(blocks), labels))
    return fit(pages)


def main_text(page: str | None, model: ChainModel) -> str:
    """Blocks of the article, one per line."""
    blocks = dom.leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = model.decode(model.scores(block_features(blocks)))
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, model: ChainModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    schema = source.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(2).to_pylist()]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema)
