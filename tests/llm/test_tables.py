"""Classifier, vector and document duplicates, page text, mixing and the pipeline."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewspark.llm import dom, graph, html_main, labelled, minhash, mixing, quality, vectors

# -- components ---------------------------------------------------------------------------------------


def plain_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(150, 150)]
    edges += [tuple(random.sample(range(200, 280), 2)) for _ in range(50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    expected = plain_components(300, edges)
    assert got == {x: expected[x] for x in {x for e in edges for x in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- near-duplicate documents -------------------------------------------------------------------------


def shingle_set(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def varied_documents(seed):
    """Groups of near copies with different numbers of edits, one far larger than a short list; small sets; common phrases."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for size in (70, 25, 6, 2):
        base = [draw.choice(words) for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 6])):
                kind, at = draw.random(), draw.randrange(len(copy))
                if kind < 0.6:
                    copy[at] = draw.choice(words)
                elif kind < 0.8:
                    del copy[at]
                else:
                    copy.insert(at, draw.choice(words[:5]))
            texts.append(" ".join(copy))
    texts += [" ".join(draw.choice(words[:4]) for _ in range(draw.randint(1, 9))) for _ in range(40)]
    texts += [" ".join(draw.choice(words) for _ in range(50)) for _ in range(15)]
    return texts + ["", None, " \n", "One", "one", "a\tb C", "A b\nc", texts[0], texts[0]]


@pytest.mark.parametrize(("width", "k"), [(2, 64), (5, 16)])
def test_groups_equal_all_pairs(spark, width, k):
    texts = varied_documents(width)
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int")
    got = {r.doc_id: r for r in minhash.near_duplicates(table, width, 0.8, k).collect()}
    sets = [shingle_set(t, width) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = plain_components(len(sets), edges)
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == expected
    assert all(got[i].kept == (expected[i] == i) for i in got)


def test_repeated_null_and_no_documents(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "x"), (None, "a b c d e f g"), (None, None), (1, "a b c d e f g")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in minhash.near_duplicates(table, 2).collect())
    assert got == [(-1, None, True), (-1, None, True), (1, 1, True), (2, 2, True), (5, 1, False), (5, 1, False)]
    assert minhash.near_duplicates(table.limit(0)).count() == 0


def near_copies(size, seed, spread):
    """Copies of one text with a number of own edits each, so that most link and some do not."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(900)}" for _ in range(150)]
    texts = []
    for _ in range(size):
        copy = list(base)
        for _ in range(draw.choice(spread)):
            copy[draw.randrange(150)] = f"x{draw.randrange(40)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("width", "block"), [(2, 1024), (2, 40), (5, 1024), (5, 40)])
def test_hot_group_in_one_task_and_in_blocks(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(300, width, [0, 1, 2, 3, 4, 6, 8] if width == 5 else [2, 6, 9, 12, 16])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table, width, 0.8).collect()}
    sets = [shingle_set(t, width) for t in texts]
    expected = plain_components(len(sets), [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert [got[i] for i in range(len(texts))] == expected
    assert 1 < len(set(expected)) < 300


@pytest.mark.parametrize("width", [2, 5])
def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch, width):
    made, plain = [], minhash._pairs_of_lists

    def counted(lists, groups, threshold):
        pairs = plain(lists, groups, threshold)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_pairs_of_lists", counted)
    for size in (150, 1500):
        texts = near_copies(size, 3, [0, 1, 2, 3, 5])
        minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, 0.8).count()
    assert made[1] <= 20 * max(made[0], 75)


def test_estimate_keeps_pairs_five_errors_low(spark):
    a = list(range(64))
    rows = [(1, 400, a), *((100 - k, 400, [*range(k), *range(1000, 1064 - k)]) for k in (30, 36, 37, 39))]
    rows = [(n, size, v if n == 1 else [*v[: 100 - n], *(x - 1000 + 64 for x in v[100 - n :])]) for n, size, v in rows]
    # the union's 64 smallest values are a's; so many of them are the other's too
    pairs = spark.createDataFrame([(1, n) for n, _, _ in rows[1:]], "a long, b long")
    sketches = spark.createDataFrame(rows, "node long, n long, values array<long>")
    assert sorted(100 - r.b for r in minhash._estimated(pairs, sketches, 0.8, 64).collect()) == [36, 37, 39]


def test_null_id_leads_no_list(spark):
    draw = random.Random(7)
    base = [f"w{draw.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base)]
    for k in range(30):  # the copies link to the base text, which has no id, and by two edits each mostly to one another
        copy = list(base)
        copy[draw.randrange(60)] = f"x{k}"
        copy[draw.randrange(60)] = f"y{k}"
        texts.append(" ".join(copy))
    big = 2**53 + 1
    table = spark.createDataFrame([(None if i == 0 else big + i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table, 2, 0.8).collect()}
    sets = [shingle_set(t, 2) for t in texts]
    pairs = itertools.combinations(range(1, len(sets)), 2)
    expected = plain_components(len(sets), [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert len(set(expected[1:])) < 12  # most copies belong together
    assert got == {None: None} | {big + i: big + expected[i] for i in range(1, len(sets))}


# -- near-duplicate vectors ---------------------------------------------------------------------------


def test_links_equal_all_cosines(spark):
    draw = np.random.default_rng(4)
    rows = [draw.standard_normal(16) for _ in range(120)]
    for size, noise in ((60, 0.05), (40, 0.13), (5, 0.02)):
        base = draw.standard_normal(16)
        rows += [base + noise * draw.standard_normal(16) for _ in range(size)]
    rows += [rows[0] * 3, rows[0], rows[0]]
    rows = [list(map(float, r)) for r in rows] + [[0.0] * 16, [math.nan] * 16, [None] * 16, None, [], [1.0, 2.0], [2.0, 4.0], [math.inf] + [1.0] * 15]
    table = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, copies int")
    units = [np.array(r) / np.linalg.norm(r) if r and all(x is not None and math.isfinite(x) for x in r) and any(r) else None for r in rows]
    linked = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if linked(units[a], units[b])]
    expected = plain_components(len(rows), edges)
    links = np.bincount(np.array(edges).ravel(), minlength=len(rows))
    for block in (1024, 16):  # the second makes large components
        got = {r.vec_id: r for r in vectors.near_duplicates(table, block=block).collect()}
        assert [got[i].n_links for i in range(len(rows))] == links.tolist()
        assert [got[i].component_id for i in range(len(rows))] == expected
    assert vectors.near_duplicates(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in vectors.near_duplicates(odd).collect()) == [(-1, 0, True), (3, 1, True), (3, 1, True)]


def hot_vectors(seed):
    """A crowd of vectors at cosine 0.85 to one another with pairs of partners in it, and a few of another length."""
    draw = np.random.default_rng(seed)
    crowd = 3 * np.ones(24) / math.sqrt(24) + 0.26 * draw.standard_normal((900, 24))
    partners = crowd[:100] + 0.15 * draw.standard_normal((100, 24))
    other = draw.standard_normal((20, 8))
    return [*crowd, *partners, *other, *(other[:10] + 0.05 * draw.standard_normal((10, 8)))]


def links_of_all_pairs(rows, cosine):
    edges = []
    for size in {len(r) for r in rows}:
        at = np.array([i for i, r in enumerate(rows) if len(r) == size])
        unit = np.stack([rows[i] for i in at])
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
        edges += list(zip(at[a].tolist(), at[b].tolist(), strict=True))
    return edges


@pytest.mark.parametrize("partitions", [8, 1, 200])
def test_crowds_lose_no_link_in_any_partitioning(spark, partitions):
    rows = hot_vectors(3)
    edges = links_of_all_pairs(rows, 0.95)
    expected = plain_components(len(rows), edges)
    links = np.bincount(np.array(edges).ravel(), minlength=len(rows)).tolist()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        table = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
        # few windows, and small cells and chunks, so that the sweep has much to find
        got = {r.vec_id: r for r in vectors.near_duplicates(table, passes=1, window=4, per_cell=40, chunk_bytes=100000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i].component_id for i in range(len(rows))] == expected
    assert [got[i].n_links for i in range(len(rows))] == links


# -- classifier ---------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels).join(labels, "doc_id")
    rows = scored.collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 5 and len(held) < len(rows) / 2
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert not [r for r in held if r.quality == 1 and not r.predicted]


def test_held_out_labels_are_never_used(spark):
    import zlib

    texts = [("fine words here again", 1), ("### $$$ %%%", 0)] * 40
    rows = [(i, t, q) for i, (t, q) in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, label string")
    # held-out labels say the opposite
    told = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows] + [(3, None), (9999, 1)]
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(told, "doc_id long, quality int")).collect()}
    assert all(got[i].predicted == q and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, q in rows)


def test_classifier_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a " * 40000), (2, "?")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.classify(docs, one).count() == 4
    assert quality.classify(docs.limit(0), one).count() == 0


def test_dual_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.unique(np.append(draw.integers(1, 50, 5), 60 + k % 2)) for k in range(60)]
    signs = np.array([1.0, -1.0] * 30)
    values = [np.ones(len(r)) / math.sqrt(len(r)) for r in rows]
    weights = quality.dual_descent(rows, values, signs, np.full(60, 10.0), 50)
    assert all(s * (weights[r] @ v) > 0.9 for s, r, v in zip(signs, rows, values))


# -- page text ----------------------------------------------------------------------------------------


def test_labelled_pages_fall_into_their_blocks_and_are_learnt():
    model = html_main.trained(400, 7)
    wrong = total = 0
    for page, labels in labelled.labelled_pages(150, 99):
        blocks = dom.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(model.scores(html_main.block_features(blocks))), labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_equals_enumeration():
    draw = np.random.default_rng(3)
    for _ in range(50):
        n = int(draw.integers(1, 8))
        model = html_main.ChainModel({}, np.zeros(0), draw.standard_normal((2, 2)), draw.standard_normal(2))
        scores = draw.standard_normal(n)

        def value(labels):
            return model.start[labels[0]] + scores @ np.array(labels) + sum(model.steps[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product([0, 1], repeat=n), key=value)
        assert value(model.decode(scores.tolist())) == pytest.approx(value(best))
        ones, pairs = html_main._marginals(scores, model.steps, model.start)
        every = list(itertools.product([0, 1], repeat=n))
        mass = np.exp([value(x) for x in every])
        assert ones == pytest.approx((mass[:, None] * np.array(every)).sum(0) / mass.sum())
        assert pairs.sum() == pytest.approx(n - 1)


PAGE = """<HTML><head><title>A title</title><script>if (a < b) { x("</p>") }</script></head><body>
<header class=masthead><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them?</div>
<article><h1>A title</h1><p>First  paragraph with an&nbsp;entity &amp; a <a href="z" title="x > y">link</a>,<br>and more text.
<p><b>Second</b> one is not closed, but long enough to be read.<!-- hidden > --></p><ul><li>An item of the list<li>another item</ul>
<div class="ad">Buy now</div><p>Last words of the article, with a full stop.</p></article>
<aside><h3>Related</h3><a href=1>Other story</a></aside><section id="comments"><h2>Comments</h2><p>I liked this article very much, thanks.</p></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer>"""


def test_main_text_of_a_page():
    assert html_main.main_text(PAGE, html_main.trained()) == (
        "A title\nFirst paragraph with an entity & a link, and more text.\nSecond one is not closed, but long enough to be read.\n"
        "An item of the list\nanother item\nLast words of the article, with a full stop."
    )


def test_pages_query_on_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "", "t"), (None, "v", "<p", "t"), (4, "w", "<div>" * 3000 + "x" * 20000, "t"), (5, "w", PAGE, "t"), (6, "q", '<a title="' * 500, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_main.extract(table).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert html_main.extract(table.limit(0)).count() == 0


# -- mixing -------------------------------------------------------------------------------------------


def filled_targets(sizes, weights, share, cap):
    """Share by weight; what exceeds a cap is shared again among the others."""
    total, targets, open_ = share * sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(t for t in targets if t is not None)
        level = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * level > cap * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = weights[k] * level
            break
        for k in over:
            targets[k] = cap * sizes[k]
            open_.discard(k)
    return targets


def test_mix_meets_targets(spark):
    draw = random.Random(8)
    rows = []
    for source, count in (("b", 300), ("a", 40), (None, 80), ("ä", 25), ("Z", 700), ("empty", 3)):
        for _ in range(count):
            size = 0 if source == "empty" else draw.choice([0, 1, 5, 20, 20, 20, 100])
            rows.append((len(rows), " ".join(["w"] * size) if size or draw.random() < 0.5 else None, source, -1))
    rows += [(7, "same same", "b", -1)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in got)
    by_target = {}
    for r in got:
        key = (r.source_size, r.target)
        by_target[key] = by_target.get(key, 0) + r.taken
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, _ in rows if s == name) for name in names]
    expected = filled_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    assert np.array(sorted(by_target)) == pytest.approx(np.array(sorted(zip(sizes, expected))))
    for (size, target), taken in by_target.items():
        assert abs(taken - target) <= 20 and taken <= 2 * size
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted((r.doc_id, r.size, r.copies) for r in again) == sorted((r.doc_id, r.size, r.copies) for r in got)
    assert mixing.mix(table.limit(0)).count() == 0


def test_apply_mix_repeats_rows(spark):
    rows = [(1, "a b", "x", "c1"), (2, "a b c", "x", "c2"), (3, None, "y", "c3"), (4, "d", "y", "c4")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.apply_mix(table)
    plan = {r.doc_id: r.copies for r in mixing.mix(table).collect()}
    counts = {i: 0 for i in plan}
    for r in got.collect():
        counts[r.doc_id] += 1
    assert got.columns == table.columns and counts == plan


def test_apply_mix_meets_targets_without_ids(spark):
    draw = random.Random(9)
    rows = [(None if k % 2 else k % 50, " ".join(["w"] * draw.choice([3, 40, 40, 90])), "abc"[k % 7 % 3], k) for k in range(700)]
    rows.append((None, "very long " * 100_000, "a", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_id long")
    plan = mixing.mix(table).collect()
    got = mixing.apply_mix(table).withColumn("size", mixing.word_count(F.col("text"))).groupBy("source").agg(F.sum("size").alias("taken"), F.max("mix_id").alias("most"))
    taken = {r.source: r.taken for r in got.collect()}
    totals = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in "abc"}
    targets = {r.source_size: (r.target, sum(x.taken for x in plan if x.source_size == r.source_size)) for r in plan}
    for s in "abc":
        target, planned = targets[totals[s]]
        assert taken[s] == planned
        assert abs(planned - target) <= (200_000 if s == "a" else 90)
    assert sorted(r.copies for r in plan if r.size == 40) == sorted(r.copies for r in mixing.mix(table.repartition(5)).collect() if r.size == 40)


# -- pipeline -----------------------------------------------------------------------------------------


def test_stages_keep_columns_and_clean_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert all(i in ids for i, q in labels.items() if q == 1)
            assert sum(i in ids for i, q in labels.items() if q == 0) <= 1
        if k == 1:
            texts = [shingle_set(r.text, 5) for r in out.collect()]
            assert not [1 for a, b in itertools.combinations([t for t in texts if t], 2) if 100 * len(a & b) >= 80 * len(a | b)]
        if k == 2:
            assert sorted(ids) == sorted(before)
            assert out.where(F.char_length("text") != F.col("n_chars")).count() == 0
        if k == 4:
            assert sorted(ids) == sorted(before)
        before, docs = ids, out


def run_stages(spark, docs, sf_dir):
    """What each stage returns, written down before the next."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf_dir), "test-stage")
        out.append(docs)
    return out


def test_stages_take_empty_tables_and_nulls(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for stage in run_stages(spark, spark.createDataFrame([], kind), sf_dir):
        assert stage.count() == 0
    rows = [(None, None, None, None, None), (1, None, "x", None, 3), (1, "words and words", None, "s", None), (1, "words and words", None, "s", None)]
    counts = [stage.count() for stage in run_stages(spark, spark.createDataFrame(rows, kind), sf_dir)]
    # short texts pass; the repeated row goes; nothing repeats over 200 bytes; rows without words go, the other comes up to twice
    assert counts[:3] == [4, 3, 3] and counts[3] == counts[4] and counts[3] in (1, 2)


CLASHING = (
    "score", "n_bytes", "kept_text", "kept_sha256", "mix_id", "row_no", "row", "id", "size", "copies", "node", "component_id", "key", "n_tokens",
    "target", "pos", "_line", "copy", "label", "n_removed", "runs", "_runs", "_text", "order", "draw", "before", "held_out", "source_no", "rate",
)


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    draw = random.Random(21)
    text = lambda n: " ".join(f"word{draw.randrange(4000)}" for _ in range(n))
    shared = text(60)
    rows = [(k, text(80), "en", "s" if k % 3 else "t", 9) for k in range(40)]
    rows += [(100 + k, f"{text(50)} {shared} {text(50)}", "en", "s", 9) for k in range(3)] + [(None, rows[0][1], "en", "s", 9), (200, "", "en", None, 0)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = plain
    for name in CLASHING:
        more = more.withColumn(name, F.coalesce(F.col("doc_id"), F.lit(-1)))
    plain_out, out = run_stages(spark, plain, sf_dir), run_stages(spark, more, sf_dir)
    for k in range(4):
        assert out[k].columns == more.columns
        got = out[k].collect()
        assert all(r[name] == (-1 if r.doc_id is None else r.doc_id) for r in got for name in CLASHING)
        assert sorted((repr(tuple(r)[:5]) for r in got)) == sorted(repr(tuple(r)) for r in plain_out[k].collect())
    assert [stage.count() for stage in plain_out[:3]] == [45, 44, 44]
    # the shared passage is cut from all three, and nothing else
    cut = [r for r in plain_out[2].collect() if r.doc_id is not None and 100 <= r.doc_id < 103]
    assert len(cut) == 3 and all(len(r.text.split()) <= 102 and shared not in r.text and r.n_chars == len(r.text) for r in cut)
    whole = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 100}
    assert {r.doc_id: r.text for r in plain_out[2].collect() if r.doc_id is not None and r.doc_id < 100} == whole
    assert sorted(r.n_tokens for r in plain_out[4].collect()) == sorted(r.n_tokens for r in out[4].collect())


def test_one_row_of_each_group_goes_on(spark, sf_dir):
    draw = random.Random(11)
    text = lambda: " ".join(f"word{draw.randrange(3000)}" for _ in range(120))
    repeated, unnamed, other = text(), text(), text()
    near = unnamed.replace(unnamed.split()[60], "changed")
    rows = [(8, repeated)] * 3 + [(None, unnamed), (None, unnamed), (None, near), (9, other), (9, text()), (None, ""), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)
    kept = corpus_pipeline.saved(corpus_pipeline.near_duplicates(spark, docs, sf_dir), "test-stage")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    nameless = sorted(t for i, t in got if i is None)
    assert len(nameless) == 3 and nameless[:2] == ["", ""] and nameless[2] in (unnamed, near)
    assert sorted(x for x in got if x[0]) == sorted({r for r in rows if r[0]})
    left = [r.text for r in corpus_pipeline.repeated_passages(spark, kept, sf_dir).collect()]
    assert sorted(filter(None, left)) == sorted(filter(None, (t for _, t in got)))
