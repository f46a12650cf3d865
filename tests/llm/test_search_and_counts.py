"""Dataset manifest, phrase collocations and nearest neighbours, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewspark.llm import manifest, neighbours, phrases

# -- manifest -----------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """(root, per leaf the (left, right) siblings upwards)."""
    paths, levels = [[] for _ in leaves], [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)])
    for i, path in enumerate(paths):
        for level in levels[:-1]:
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
    return levels[-1][0], paths


def plain_manifest(rows, tampers):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by_source[s]])
    root, over = plain_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over, strict=True):
        for row, path in zip(by_source[s], trees[s][1], strict=True):
            node = plain_leaf((*row[:4], row[4].replace("\n", "") if row[4] is not None else None)) if tampers(row[0]) else plain_leaf(row)
            for left, right in path + above:
                node = sha(left + node + right)
            out.append((row[0], plain_leaf(row), trees[s][0], root, sha("".join(a + b for a, b in path + above)), node, node == root))
    return out


def even(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def manifest_rows(docs):
    changed = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    got = manifest.manifest(docs, tampered=changed, tampered_where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return [tuple(r) for r in got.collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_manifest_equals_the_plain_tree(spark):
    draw = random.Random(5)
    sizes = {"hot": 800, "one": 1, "three": 3, "ä": 243, "power": 27, None: 5, "b": 244}
    ids = iter(draw.sample(range(-5000, 5000), sum(sizes.values())))
    rows = [(next(ids), s, draw.choice(["en", None]), draw.choice([7, None]), draw.choice(["a\nb", "", None, "né\n", "x"])) for s, n in sizes.items() for _ in range(n)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    expected = by_text(plain_manifest(rows, even))
    assert by_text(manifest_rows(docs)) == expected
    # other columns, whatever they are called, and the partitioning do not matter
    more = docs.repartition(7)
    for name in ("key", "node", "id", "pos", "path", "level0", "member", "top", "task", "height", "leaf"):
        more = more.withColumn(name, F.lit(name))
    assert by_text(manifest_rows(more)) == expected
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)


def test_manifest_of_repeated_rows_nulls_and_nothing(spark):
    rows = [(4, "s", "en", 1, "x\n")] * 400 + [(None, "s", None, None, None)] * 3 + [(4, "s", "en", 2, "y")] * 2 + [(1, None, None, None, "long " * 200_000)]
    assert by_text(manifest_rows(spark.createDataFrame(rows, DOCS))) == by_text(plain_manifest(rows, even))
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []
    lone = [(3, "s", "en", 1, "x")]
    got = manifest_rows(spark.createDataFrame(lone, DOCS))[0]
    assert got[1] == got[2] == got[3] == got[5] and got[4] == sha("")


# -- phrases ------------------------------------------------------------------------------------------


def plain_collocations(rows, threshold, most, percent=100, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    frequent = {k: v for k, v in counts.items() if v >= threshold}
    by_lang = {}
    for (lang, p), a in frequent.items():
        if len(p) == 1:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(len(q) > len(p) and other == lang and 100 * f >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), f in frequent.items())
        if not inside:
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def wordy(seed, n=240):
    draw = random.Random(seed)
    words = ["a", "B", "the", "Über", "x.y", "c\tc", "end\n", "é", "long", "w"]
    weights = [30, 8, 20, 3, 2, 2, 4, 5, 1, 6]
    rows = []
    for k in range(n):
        text = " ".join(draw.choices(words, weights, k=draw.randint(0, 30)))
        if k % 3 == 0:
            text += " the long tail of a phrase, the long tail of a phrase"
        rows.append((draw.choice(["en", "en", "de", None]), draw.choice([text, text, text, "", None])))
    return rows


@pytest.mark.parametrize(("seed", "slots", "shards", "percent"), [(1, 1 << 16, 2, 100), (2, 64, 3, 100), (3, 1 << 12, 1, 60)])
def test_collocations_equal_plain_counts(spark, seed, slots, shards, percent):
    rows = wordy(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, threshold=9, most=25, slots=slots, shards=shards, absorbed_percent=percent, slice_rows=10)
    expected = plain_collocations(rows, 9, 25, percent)
    assert sorted(map(tuple, got.collect())) == expected
    assert len(expected) > 40 and any(len(r[2].split()) == 5 for r in expected)


def test_a_phrase_that_becomes_frequent_late_is_counted_whole(spark):
    # the words of the late phrase reach the threshold only in the last rows, so it is counted in the second cycle
    rows = [("en", "early bird early bird")] * 40 + [("en", "late comer here now then")] * 7
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = sorted(map(tuple, phrases.collocations(docs, threshold=7, most=50, shards=2).collect()))
    assert got == plain_collocations(rows, 7, 50)
    assert "late comer here now then" in {r[2] for r in got}


def test_collocations_of_one_hot_phrase_extra_columns_and_nothing(spark):
    rows = [("en", "same line here")] * 500 + [("en", "z" * 300_000 + " once"), (None, "same line"), ("en", None), ("en", "  ,;\n")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for name in ("shard", "phrase", "n", "score", "c"):
        docs = docs.withColumn(name, F.lit(1))
    assert sorted(map(tuple, phrases.collocations(docs, shards=2).collect())) == plain_collocations(rows, 100, 2000)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), shards=1).collect() == []


# -- nearest neighbours -------------------------------------------------------------------------------


def plain_neighbours(vectors, asked, k):
    """{query: [(distance, id)]} over (id, vector) pairs that are fit."""
    fit = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in fit:
        if asked(q):
            best = out.setdefault(q, {})
            for i, y in fit:
                if i != q and len(x) == len(y):
                    d = math.sqrt(float(((y - x) ** 2).sum()))
                    best[i] = min(d, best.get(i, math.inf))
    return {q: sorted((d, i) for i, d in found.items())[:k] for q, found in out.items()}


def found_neighbours(spark, vectors, asked, k=10, kind="double", **kwargs):
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, score string")
    out = {}
    for r in neighbours.search(table, asked, k, **kwargs).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in e}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


def same(a, b):
    return len(a) == len(b) and all(i == j and abs(x - y) < 1e-9 for (x, i), (y, j) in zip(a, b, strict=True))


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).standard_normal((5, 64))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)
    turned = neighbours.rotated(x, 3)
    assert np.allclose(turned @ turned.T, x @ x.T)
    assert (neighbours.probes(turned)[:, 0] == neighbours.buckets(turned)).all()


@pytest.mark.parametrize("spread", ["even", "clusters", "lengths"])
def test_recall_against_brute_force(spark, spread):
    draw = np.random.default_rng(7)
    x = draw.standard_normal((2500, 24))
    if spread == "clusters":
        x = draw.standard_normal((25, 24))[draw.integers(0, 25, 2500)] + 0.2 * x
    x /= np.sqrt((x * x).sum(1))[:, None]
    if spread == "lengths":
        x *= draw.uniform(0.2, 3, 2500)[:, None]
    vectors = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = found_neighbours(spark, vectors, F.col("id") % 50 == 0, block=300, asks=7)
    expected = plain_neighbours(vectors, lambda i: i % 50 == 0, 10)
    assert set(got) == set(expected) and all(len(v) == 10 for v in got.values())
    assert recall(got, expected) >= 0.95
    exact = {i: dict((j, d) for d, j in plain_neighbours([vectors[i], *vectors], lambda q: q == i, 2500)[i]) for i in (0, 50)}
    assert all(abs(exact[q][i] - d) < 1e-12 for q in exact for d, i in got[q])


def test_a_query_that_finds_little_looks_everywhere(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.standard_normal(16).tolist()) for i in range(14)] + [(100, [1.0, 0.0]), (200, [0.0, 2.0]), (300, [5.0])]
    got = found_neighbours(spark, vectors, F.col("id") % 2 == 0)
    expected = plain_neighbours(vectors, lambda i: i % 2 == 0, 10)
    assert set(got) == {q for q, found in expected.items() if found}
    assert all(same(got[q], expected[q]) for q in got)


def test_ties_copies_repeated_rows_and_unfit_vectors(spark):
    near = [1.0, 0.5, 0.25, 0.0]
    vectors = [(i, near) for i in range(0, 600)] + [(600, [1.0, 0.5, 0.25, 0.01])] * 5
    vectors += [(700, None), (701, []), (702, [0.0] * 4), (703, [1.0, None, 0.0, 0.0]), (704, [math.nan, 1.0, 0.0, 0.0]), (705, [math.inf, 1.0, 0.0, 0.0])]
    vectors += [(None, near), (800, [1e200, 1e200, 0.0, 0.0]), (-50, [-1.0, 0.0, 0.0, 2.0])]
    got = found_neighbours(spark, vectors, F.pmod("id", F.lit(50)) == 0, kind="double", block=50, asks=3)
    assert [i for _, i in got[0]] == list(range(1, 11)) and {d for d, _ in got[0]} == {0.0}
    assert [i for _, i in got[600]] == list(range(10)) and len({d for d, _ in got[600]}) == 1
    assert set(got) == {-50, 800, *range(0, 601, 50)}
    assert len(got[800]) == 10
    assert found_neighbours(spark, [], F.lit(True)) == {}
    assert found_neighbours(spark, [(1, near)], F.lit(True)) == {}


def test_one_id_with_many_vectors_is_one_candidate(spark):
    draw = np.random.default_rng(4)
    vectors = [(1, draw.standard_normal(8).tolist())] + [(2, draw.standard_normal(8).tolist()) for _ in range(40)] + [(k, draw.standard_normal(8).tolist()) for k in range(3, 9)]
    got = found_neighbours(spark, vectors, F.col("id") == 1, k=5, first_share=1.0)
    assert same(got[1], plain_neighbours(vectors, lambda i: i == 1, 5)[1])


def test_counts_travel_without_texts(spark, monkeypatch):
    """Tables between the scans hold a row per phrase, and texts are written for frequent phrases only."""
    written, plain = {}, phrases.saved

    def looked_at(df, label):
        got = plain(df, label)
        written.setdefault(label, []).append(got)
        return got

    monkeypatch.setattr(phrases, "saved", looked_at)
    rows = [("en", f"one two three four w{k} x{k} y{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    found, totals = phrases.frequent_phrases(docs, threshold=30, longest=3, shards=2)
    assert totals.collect()[0].n == 40 * 7
    assert {(r.phrase, r.f) for r in found.collect()} == {(p, 40) for p in ("one", "two", "three", "four", "one two", "two three", "three four", "one two three", "two three four")}
    with_text = [label for label, dfs in written.items() if any("phrase" in df.columns for df in dfs)]
    assert with_text == ["phrases-frequent"]
    for df in written["phrases-open"]:
        assert df.count() == df.select("hash", "tag").distinct().count()
