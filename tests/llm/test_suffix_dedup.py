"""Suffix order against plain sorting, and removal of repeats against a count of all windows."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reviewspark.llm import induced, suffix_dedup


def plain_order(text, limit):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for x, y in zip(order, order[1:]):
        k = 0
        while k < limit and x + k < len(text) and y + k < len(text) and text[x + k] == text[y + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("memory", [1 << 20, 64])
def test_suffix_order(memory, monkeypatch):
    draw = np.random.default_rng(1)
    for case in range(400):
        size, letters = int(draw.integers(1, 60)), int(draw.integers(1, 5))
        text = draw.integers(1, letters + 1, size)
        if case % 3 == 0:
            text = np.tile(text[: max(1, size // 8)], 9)
        if case == 300:
            monkeypatch.setattr(induced, "MAX_SYMBOLS", 1)
        text = np.append(text, 0).astype(np.uint16)
        order, shared = induced.suffix_order(text, 1000, True, memory)
        assert (order.tolist(), shared.tolist()) == plain_order(text.tolist(), 1000)


def brute(docs, length):
    counts = collections.Counter(b[i : i + length] for b in docs for i in range(len(b) - length + 1))
    for b in docs:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        yield len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "shard_bytes"), [(20, 1 << 20), (41, 3000)])
def test_removal_equals_window_counts(spark, length, shard_bytes):
    random.seed(length)
    base = ["".join(random.choice("abé ") for _ in range(random.randint(5, 60))) for _ in range(12)]
    docs = ["".join(random.choice(base) for _ in range(random.randint(0, 9))) for _ in range(60)]
    docs += ["ab" * 200, "a" * 333, "", "x", None, base[0] * 3, base[0] * 3]
    table = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(docs)], "doc_id long, text string, key string, runs int")
    rows = suffix_dedup.remove_repeats(table, length, shard_bytes=shard_bytes).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    expected = dict(enumerate(brute([(t or "").encode() for t in docs], length)))
    assert got == expected


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "z" * 30), (1, "z" * 30), (None, "y" * 5), (None, "abcdefghij0123456789"), (2, "abcdefghij0123456789")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table, 20).collect())
    assert got == [(-1, 5, 0), (-1, 20, 20), (1, 30, 30), (1, 30, 30), (2, 20, 20)]
    assert suffix_dedup.remove_repeats(table.limit(0), 20).count() == 0


def test_kept_text_carries_columns(spark):
    table = spark.createDataFrame([(1, "héllo wörld, héllo", "s"), (2, "wörld, héllo!", "t")], "doc_id long, text string, source string")
    rows = suffix_dedup.remove_repeats(table, 12, keep_text=True).orderBy("doc_id").collect()
    assert [(r.source, r.kept_text) for r in rows] == [("s", "héllo "), ("t", "!")]


def test_a_shard_takes_few_bytes_per_byte():
    draw = np.random.default_rng(2)
    words = [bytes(draw.integers(99, 124, int(k)).astype(np.uint8)) for k in draw.integers(2, 9, 5000)]
    raw = b"\x22".join(words[i] for i in draw.zipf(1.2, 200_000) % len(words))
    raw = (raw + raw[:200_000] + raw)[:1_500_000]
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 2, [1, 0]).astype(np.uint16)
    ends = np.array([0]), np.array([0]), np.array([len(raw) - 399])
    suffix_dedup._repeated_starts(text[-5000:], ends[0], ends[1], np.array([4000]), 400)
    tracemalloc.start()
    (starts, stops), *_ = suffix_dedup._repeated_starts(text, *ends, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert starts and stops
    assert peak < 30 * len(raw)


def test_no_shard_is_larger_than_its_bound(spark):
    random.seed(3)
    sizes = [(a, random.choice([90, 2000, 5100, 9999, 10_000])) for a in (random.getrandbits(62) - 2**61 for _ in range(400))]
    rows = suffix_dedup._dealt(spark.createDataFrame(sizes, "anchor long, size long"), 10_000).collect()
    held = collections.Counter()
    for r in rows:
        held[r.slice, r.shard] += r.size
    assert sorted((r.anchor, r.size) for r in rows) == sorted(sizes)
    assert max(held.values()) <= 10_000
    assert len(held) <= 3 * sum(size for _, size in sizes) // 10_000
    assert suffix_dedup._dealt(spark.createDataFrame([], "anchor long, size long"), 10_000).count() == 0


def test_a_segment_that_comes_many_times_is_sorted_once():
    raw = "abcdefghij0123456789abcdefghij".encode()
    row = pa.RecordBatch.from_pylist([{"anchor": 5, "whole": 6, "low": 0, "high": 21, "bytes": raw}])
    found = [r for b in suffix_dedup._shard_runs(10)(iter([row] * 50)) for r in b.to_pylist()]
    assert found == [{"anchor": 5, "whole": 6, "starts": [0, 20], "stops": [1, 21]}]
