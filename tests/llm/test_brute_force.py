"""Production parameters on the given tables, and the classifier's solver, each against a plain version."""

import collections
import hashlib

import numpy as np

from reviewspark.llm import quality, suffix_dedup


def test_removal_of_400_bytes_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    raws = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    length = 400
    digest = lambda b, i: hashlib.blake2b(b[i : i + length], digest_size=12).digest()
    starts = {k: [digest(b, i) for i in range(len(b) - length + 1)] for k, b in raws.items()}
    counts = collections.Counter(d for own in starts.values() for d in own)
    expected = {}
    for k, b in raws.items():
        covered = np.zeros(len(b) + 1, np.int32)
        for i, d in enumerate(starts[k]):
            if counts[d] > 1:
                covered[i] += 1
                covered[min(i + length, len(b))] -= 1
        gone = np.cumsum(covered[:-1]) > 0 if len(b) else np.zeros(0, bool)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        expected[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length).collect()}
    assert got == expected
    assert sum(x[1] > 0 for x in expected.values()) > 10


def plain_dual(gram, costs, steps=60_000):
    """Projected gradient on the dual of the hinge loss: min a'Qa/2 - sum a, 0 <= a <= cost."""
    dual, rate = np.zeros(len(costs)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(steps):
        dual = np.clip(dual - rate * (gram @ dual - 1), 0, costs)
    return dual


def test_dual_descent_reaches_the_plain_optimum():
    draw = np.random.default_rng(12)
    rows = [np.unique(draw.integers(0, 40, 9)) for _ in range(50)]
    labels = np.array([int(3 in r or draw.random() < 0.3) for r in rows])
    ratios = quality.log_ratios(rows, labels)
    for k in range(40):  # the ratio of shares of documents, with smoothing
        share = [(sum(k in r for r, y in zip(rows, labels) if y == c) + quality.SMOOTHING) / (sum(labels == c) + 2 * quality.SMOOTHING) for c in (0, 1)]
        assert k == 0 or abs(ratios[k] - np.log(share[1] / share[0])) < 1e-12
    values = quality.scaled(rows, ratios)
    signs = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, 0.7, 1.3)
    dense = np.zeros((50, 40))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r] = v
    signed = dense * signs[:, None]
    best = signed.T @ plain_dual(signed @ signed.T, costs)
    found = quality.dual_descent(rows, values, signs, costs, 20_000)[:40]

    def loss(w):
        return w @ w / 2 + (costs * np.maximum(0, 1 - signed @ w)).sum()

    assert loss(found) <= loss(best) * 1.0005 and np.abs(found - best).max() < 0.02
