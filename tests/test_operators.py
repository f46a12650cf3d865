"""Hand-worked cases of text, record, filter, rule, selection, metric and resampling operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewspark.functions import records
from reviewspark.functions import text as tx
from reviewspark.learning.models import hard_vote, soft_vote, vote_decision, weighted_vote
from reviewspark.operators import active, filters, metrics, ranking, resample, rules
from reviewspark.plans import combine
from reviewspark.schema import to_articles


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


TEXTS = ["Non-Small  Cell!", "Ça-va_bien  à\tl'œuvre²", "", None, "   x y ", "Straße; naïve—co-op", "日本 語。", "a.b"]


def test_text_functions_follow_their_definition(spark):
    word = re.compile(r"[^\w\s]")
    plain = [t or "" for t in TEXTS]
    assert column(spark, TEXTS, tx.normalize_title) == [" ".join(word.sub("", t.lower()).split()) for t in plain]
    assert column(spark, TEXTS, tx.clean_text) == [" ".join(word.sub(" ", t).split()).lower() for t in plain]
    assert column(spark, TEXTS, tx.words) == [sorted(set(t.split())) for t in plain]
    assert column(spark, ["a b a", None], lambda c: tx.clean_text(c, c)) == ["a b a a b a", ""]
    assert column(spark, TEXTS, lambda c: tx.has_words(c)) == [bool(word.sub(" ", t).strip()) for t in plain]


def test_author_key(spark):
    names = ["Smith, John and Ann de Vries", "  Plato ", "", None, "Lee, B and and C Ng", "Ö, x and a, y"]
    assert column(spark, names, tx.author_key) == ["smith vries", "plato", "", "", "lee ng", "a ö"]


def test_whole_word_counts(spark):
    texts = ["Trial trial trials, trial", "meta-analysis non-meta-analysis-x metaXanalysis", "étude trialé", ""]
    assert column(spark, texts, lambda c: tx.count_whole_word(c, "trial")) == [3, 0, 0, 0]
    assert column(spark, texts, lambda c: tx.count_whole_word(c, "meta-analysis")) == [0, 2, 0, 0]


def test_jaccard(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "a"), ("a", "a")], "l string, r string")
    got = [r[0] for r in df.select(tx.jaccard(tx.words("l"), tx.words("r"))).collect()]
    assert got == [0.5, 0.0, 1.0]


def test_creator_and_names(spark):
    made = column(spark, ["Jan van der Berg, Plato", "", None], records.split_creator)
    assert [(p.last_name, p.first_name, p.initials) for p in made[0]] == [("Berg", "Jan van der", "Jvd"), ("Plato", "", "")]
    assert made[1] == [] and made[2] == []
    text = column(spark, ["Jan van der Berg, Plato"], lambda c: records.format_person(records.split_creator(c)))
    assert text == ["Jan van der Berg and Plato"]


def test_keys_and_prefixes(spark):
    df = spark.createDataFrame([("my_db", "my_db_key_1")], "source string, entry_id string")
    assert df.select(records.strip_source_prefix("entry_id", "source")).collect()[0][0] == "key_1"
    made = to_articles(df, "s", F.lit(1), F.col("entry_id"))
    assert made.select(records.author_year_key("authors", "year", F.lit("7"))).collect()[0][0] == "unknown_7"
    fields = F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x"))
    assert df.select(records.drop_blank_fields(fields)).collect()[0][0] == {"b": "x"}


ART = "entry_id string, ord long, source string, title string, abstract string, keywords string, entry_type string, year string"


def articles(spark):
    rows = [
        ("a", 1, "s1", "Lung cancer trial", "An animal study of mice", "oncology", "article", "2001"),
        ("b", 2, "s1", "Clinical", "trial of drugs", "", "review", "2005"),
        ("c", 3, "s2", "Nothing", None, None, "article", ""),
        ("d", 4, "s1", "?", "", "", "letter", "x"),
    ]
    return spark.createDataFrame(rows, ART)


def ids(df):
    return sorted(r.entry_id for r in df.collect())


def test_rules(spark):
    got = {r.entry_id: r for r in rules.rule_screen(articles(spark), ["Animal study", "mice"], ["clinical trial", "Lung"]).collect()}
    assert (got["a"].decision, got["a"].reason, got["a"].confidence) == ("exclude", "Exclusion criterion met: Animal study", 0.9)
    assert (got["b"].decision, got["b"].reason) == ("include", "Inclusion criterion met: clinical trial")  # over the seam
    assert (got["c"].decision, got["c"].confidence) == ("uncertain", 0.5)
    nothing = rules.rule_screen(articles(spark), [], [])
    assert {r.decision: r.n for r in rules.decision_counts(nothing).collect()} == {"include": 0, "exclude": 0, "uncertain": 4}


def test_rules_match_a_sequential_twin(spark):
    rnd = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "delta", "x"]
    rows = [(f"e{i}", i, "s", " ".join(rnd.choices(vocab, k=3)), " ".join(rnd.choices(vocab, k=4)), "", "", "") for i in range(60)]
    out_terms, in_terms = ["alpha beta", "gamma x"], ["DELTA", "beta gamma"]

    def twin(title, abstract):
        body = f"{title.lower()} {abstract.lower()}"
        for kind, terms in (("exclude", out_terms), ("include", in_terms)):
            for t in terms:
                if t.lower() in body:
                    return kind, t
        return "uncertain", None

    got = {r.entry_id: r for r in rules.rule_screen(spark.createDataFrame(rows, ART), out_terms, in_terms).collect()}
    for row in rows:
        kind, term = twin(row[3], row[4])
        assert got[row[0]].decision == kind and (term is None or got[row[0]].reason.endswith(f": {term}"))


def test_filters(spark):
    a = articles(spark)
    assert ids(filters.strategy_filter(a, {"p": ["lung", "drugs"], "study_design": ["review"], "x": []})) == ["b"]
    assert ids(filters.strategy_filter(a, {"p": ["lung", "cancer"]}, within="AND")) == ["a"]
    assert ids(filters.strategy_filter(a, {"p": ["lung"], "q": ["drugs"]}, between="OR")) == ["a", "b"]
    assert ids(filters.strategy_filter(a, {})) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        filters.strategy_filter(a, {"p": ["x", "y"]}, within="NEAR")
    assert ids(filters.date_range_filter(a, "2001-06-01", "2004-01-01")) == ["a"]
    assert ids(filters.facet_filter(a, {"entry_type": ["Article"], "source": []})) == ["a", "c"]
    assert ids(filters.enabled_source_filter(a, {"s1": False, "s9": True})) == ["c"]
    assert ids(filters.limit_results(a, 2)) == ["a", "b", "c"]
    assert ids(filters.drop_empty_text(a)) == ["a", "b", "c"]
    assert {r.source: r.n for r in filters.source_counts(a).collect()} == {"s1": 3, "s2": 1, "combined": 4}
    with pytest.raises(ValueError, match="cannot be looked up"):
        filters.lookup_by_id(a, spark.createDataFrame([("x",)], "id string"), "isbn")
    wanted = spark.createDataFrame([("10.1/b",), ("10.1/b",)], "id string")
    with_doi = a.withColumn("doi", F.concat(F.lit("10.1/"), "entry_id"))
    assert ids(filters.lookup_by_id(with_doi, wanted, "doi")) == ["b"]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "entry_id string, ord long, prediction int, probability double").repartition(3)


SCORES = [("a", 1, 1, 0.5), ("b", 2, 0, 0.0), ("c", 3, 1, 1.0), ("d", 4, 0, 0.4), ("e", 5, 1, 0.6), ("f", 6, 1, 0.5)]


def order(df):
    return [r.entry_id for r in df.collect()]


def test_selectors(spark):
    p = predictions(spark, SCORES)
    assert order(active.select_uncertainty(p, 4)) == ["a", "f", "d", "e"]
    assert len(order(active.select_uncertainty(p, 100))) == 6
    assert order(active.select_random(p, 3)) == order(active.select_random(p.repartition(5), 3))
    assert set(order(active.select_combined(p, 1))) <= {"a", "f", "d"} | {"e"}
    assert order(active.select_model_change(p, 2)) == ["a", "f"]
    norm = p.withColumn("norm", F.when(F.col("entry_id") == "d", 10.0).otherwise(1.0))
    assert order(active.select_model_change(norm, 1, "norm")) == ["d"]


def test_committee(spark):
    one = predictions(spark, SCORES)
    two = predictions(spark, [("a", 1, 0, 0.1), ("c", 3, 1, 0.9)])
    assert order(active.select_committee([one, two], 2)) == ["a", "b"]
    votes = {r.entry_id: (r.votes, r.disagreement) for r in active.committee_join([one, two]).collect()}
    assert votes["a"] == (2, 0.25) and votes["b"] == (1, 0.0)


def test_k_center_takes_the_farthest_each_time(spark):
    rnd = random.Random(1)
    points = {f"p{i}": [rnd.gauss(0, 1) for _ in range(4)] for i in range(30)}
    df = spark.createDataFrame([(k, v) for k, v in points.items()], "entry_id string, embedding array<double>")
    got = set(order(active.select_k_center(df, 6)))

    def distance(x, y):
        dot = sum(a * b for a, b in zip(x, y))
        return 1 - dot / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)

    chosen = order(active.select_random(df, 1))
    while len(chosen) < 6:
        rest = [k for k in points if k not in chosen]
        chosen.append(max(rest, key=lambda k: min(distance(points[k], points[c]) for c in chosen)))
    assert got == set(chosen)


def test_merge_and_projection(spark):
    decided = rules.rule_screen(articles(spark), ["mice"], [])
    merged = {r.entry_id: r for r in rules.merge_decisions(decided, predictions(spark, [("a", 1, 1, 0.9), ("b", 2, 0, 0.25)])).collect()}
    assert (merged["a"].decision, merged["a"].ml_probability) == ("exclude", None)
    assert (merged["b"].decision, merged["b"].confidence, merged["b"].ml_probability) == ("exclude", 0.75, 0.25)
    assert merged["b"].reason == "ML model predicts exclusion (probability: 0.75)"
    assert merged["c"].decision == "uncertain"


def test_training_guards(spark):
    one_class = spark.createDataFrame([("a", 1), ("b", 1)], "entry_id string, label int")
    with pytest.raises(ValueError, match="both positive"):
        rules.training_guards(one_class)
    with pytest.raises(ValueError, match="Not enough"):
        rules.training_guards(one_class.filter("entry_id = 'a'"))


def test_votes(spark):
    df = spark.createDataFrame([(0.9, 0.2, None)], "a double, b double, c double")
    row = df.select(
        soft_vote([F.col("a"), F.col("b")]).alias("soft"), hard_vote([F.lit(1), F.lit(0)]).alias("hard"),
        vote_decision(F.lit(0.5)).alias("tie"), vote_decision(F.lit(0.5), "weighted").alias("at"),
        weighted_vote([F.col("a"), F.col("b"), F.col("c")], [2.0, 1.0, 1.0]).alias("weighted"),
    ).collect()[0]
    assert (row.soft, row.hard, row.tie, row.at) == (0.55, 0.5, 0, 1)
    assert abs(row.weighted - 0.5) < 1e-12  # the third member's weight is lost, not shared out
    with pytest.raises(ValueError):
        weighted_vote([None, None])


def test_metrics_with_ties_and_single_class(spark):
    rnd = random.Random(7)
    rows = [(f, int(rnd.random() < 0.4), 0, rnd.choice([0.1, 0.3, 0.3, 0.7, rnd.random()])) for f in (0, 1) for _ in range(80)]
    rows = [(f, y, int(p >= 0.5), p) for f, y, _, p in rows] + [(2, 1, 0, 0.2), (2, 1, 0, 0.4)]
    df = spark.createDataFrame(rows, "fold int, label int, prediction int, probability double").repartition(4)
    got = {r.fold: r for r in metrics.binary_metrics(df, ["fold"]).collect()}
    for fold in (0, 1):
        pos = [p for f, y, _, p in rows if f == fold and y == 1]
        neg = [p for f, y, _, p in rows if f == fold and y == 0]
        auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert abs(got[fold].auc - auc) < 1e-12
    assert got[2].f1 == got[2].precision == got[2].recall == 0.0 and got[2].auc != got[2].auc
    summary = {r.metric: r for r in metrics.metric_summary(metrics.long_metrics(metrics.binary_metrics(df, ["fold"]))).collect()}
    assert summary["auc"].mean != summary["auc"].mean and summary["f1"].mean == summary["f1"].mean
    whole = metrics.binary_metrics(df).collect()[0]
    assert 0 < whole.auc < 1


def labelled(spark, n_pos, n_neg, dim=3, seed=0):
    rnd = random.Random(seed)
    rows = [(f"r{i}", int(i < n_pos), [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n_pos + n_neg)]
    return spark.createDataFrame(rows, "id string, label int, features array<double>").repartition(4), {r[0]: r for r in rows}


def sizes(df):
    return {r.label: r["count"] for r in df.groupBy("label").count().collect()}


def test_synthetic_rows_lie_between_near_minority_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 7)  # several blocks
    df, rows = labelled(spark, 20, 100)
    near = resample.nearest_neighbours(df.filter("label = 1"), 5, 20).collect()
    points = {k: r[2] for k, r in rows.items() if r[1] == 1}

    def nearest(k):
        others = sorted((sum((a - b) ** 2 for a, b in zip(points[k], v)), o) for o, v in points.items() if o != k)
        return [o for _, o in others[:5]]

    found = {}
    for r in near:
        found.setdefault(r.id, {})[r.slot] = r.neighbour
    assert {k: [v[i] for i in range(1, 6)] for k, v in found.items()} == {k: nearest(k) for k in points}
    made = resample.synthetic_rows(df.filter("label = 1"), 20, 30, 5).collect()
    assert len(made) == 30
    for r in made:
        a, b = points[r.from_id], points[r.neighbour]
        assert r.neighbour in nearest(r.from_id)
        gaps = [(x - p) / (q - p) for x, p, q in zip(r.features, a, b)]
        assert 0 <= gaps[0] < 1 and max(gaps) - min(gaps) < 1e-9


def test_resampling_arithmetic(spark):
    df, _ = labelled(spark, 20, 100)
    assert sizes(resample.oversample(df)) == {1: 50, 0: 100}
    assert sizes(resample.undersample(df)) == {1: 20, 0: 25}
    assert sizes(resample.resample(df)) == {1: 50, 0: 62}
    assert sizes(resample.resample(df, "over")) == {1: 50, 0: 100}
    close, _ = labelled(spark, 90, 100)
    assert sizes(resample.resample(close)) == {1: 90, 0: 100}  # the cut is impossible: original rows
    assert sizes(resample.oversample(close)) == {1: 90, 0: 100}
    with pytest.raises(ValueError):
        resample.undersample(close)
    tiny, _ = labelled(spark, 1, 10)
    assert sizes(resample.resample(tiny)) == {1: 1, 0: 10}
    again = resample.undersample(df.repartition(7))
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in resample.undersample(df).collect())


def test_folds_are_even_and_stable(spark):
    df, _ = labelled(spark, 13, 41)
    folds = resample.stratified_folds(df, 5, entry_id="id")
    counts = folds.groupBy("label").pivot("fold").count().collect()
    for row in counts:
        values = [row[str(i)] for i in range(5)]
        assert max(values) - min(values) <= 1
    one = {r.id: r.fold for r in folds.collect()}
    assert one == {r.id: r.fold for r in resample.stratified_folds(df.repartition(2), 5, entry_id="id").collect()}


def test_row_index(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [(r["k"], r["index"]) for r in ranking.row_index(df, "k").collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got))]


def test_limit_ranks_only_the_range_of_the_cap(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot"] * 9 + ["b", None, ""]), f"e{k}", draw.randrange(10_000) * 1000 + k) for k in range(3000)]
    df = spark.createDataFrame(rows, "source string, entry_id string, ord long").repartition(5)
    by_source = {}
    for source, entry, place in sorted(rows, key=lambda r: r[2]):
        by_source.setdefault(source, []).append((place, entry))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for cap in (0, 1, 7, 250, 2_000, 10_000):
            got = {(r.source, r.entry_id) for r in filters.limit_results(df, cap).collect()}
            assert got == {(s, e) for s, found in by_source.items() for _, e in found[:cap]}
        caps = spark.createDataFrame([("hot", 1234), ("b", None), (None, 2), ("nowhere", 5)], "source string, max_results int")
        got = {(r.source, r.entry_id) for r in filters.limit_results(df, caps).collect()}
        limits = {"hot": 1234, None: 2}
        assert got == {(s, e) for s, found in by_source.items() for _, e in found[: limits.get(s, len(found))]}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert filters.limit_results(df.limit(0), 3).count() == 0


def test_options_differ_per_source(spark):
    rows = [
        ("a", "a1", 1, "lung cancer", "x", "2010", "English", ["Review"]),
        ("a", "a2", 2, "other", "lung cancer", "2011", "english", ["Article"]),
        ("a", "a3", 3, "lung cancer", "", "2012", "German", ["Review", "Letter"]),
        ("b", "b1", 4, "lung cancer", "", "", "English", []),
        ("b", "b2", 5, "lung cancer", "", "2019", "English", ["review"]),
        ("c", "c1", 6, "lung cancer", "", "2010", "English", ["Review"]),
        ("d", "d1", 7, "lung cancer", "", "1990", "", []),
    ]
    df = spark.createDataFrame(rows, "source string, entry_id string, ord long, title string, abstract string, year string, language string, publication_type array<string>")
    df = df.withColumn("keywords", F.lit("")).withColumn("entry_type", F.lit("article"))
    kind = (
        "source string, enabled boolean, max_results int, fields array<string>, languages array<string>, article_types array<string>, "
        "species array<string>, subject_areas array<string>, document_types array<string>, evidence_types array<string>, "
        "date_range struct<start:string,end:string>"
    )
    def options(species=None):
        return spark.createDataFrame(
            [
                ("a", True, 1, ["title"], ["ENGLISH"], None, species, None, None, None, ("2010-01-01", None)),
                ("b", None, None, None, None, ["Review"], None, [], None, None, ("2000-01-01", "2019-12-31")),
                ("c", False, None, None, None, None, None, None, None, None, None),
            ],
            kind,
        )

    wanted = combine.Search(strategy={"p": ["lung"]}, options=options())
    assert sorted(r.entry_id for r in combine.search(df, wanted).collect()) == ["a1", "b2", "d1"]
    everywhere = combine.Search(strategy={"p": ["lung"]}, options=options().withColumn("fields", F.lit(None).cast("array<string>")).withColumn("max_results", F.lit(None).cast("int")))
    assert sorted(r.entry_id for r in combine.search(df, everywhere).collect()) == ["a1", "a2", "b2", "d1"]
    with pytest.raises(Exception, match="no column 'species'"):
        combine.search(df, combine.Search(options=options(["humans"]))).collect()


def test_sparse_neighbours_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resample, "BLOCK_ROWS", 40)
    draw = np.random.default_rng(6)
    sparse = draw.random((150, 60)) * (draw.random((150, 60)) < 0.06)
    sparse[20:25] = sparse[20]  # equal points: ties go by id
    sparse[30] = 0
    for matrix in (sparse, draw.standard_normal((90, 7))):
        rows = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(matrix)]
        got = resample.nearest_neighbours(spark.createDataFrame(rows, "id string, features array<double>"), 4, len(rows)).collect()
        found = {(r.id, r.slot): r.neighbour for r in got}
        assert len(found) == 4 * len(rows)
        for i, (name, _) in enumerate(rows):
            distance = ((matrix - matrix[i]) ** 2).sum(1)
            order = sorted((round(float(d), 12), rows[j][0]) for j, d in enumerate(distance) if j != i)
            mine = [round(float(distance[int(found[name, s][1:])]), 12) for s in range(1, 5)]
            assert mine == [d for d, _ in order[:4]]
            if order[3][0] != order[4][0] and len({d for d, _ in order[:4]}) == 4 or i in range(20, 25):
                assert [found[name, s] for s in range(1, 5)] == [e for _, e in order[:4]]


def test_blocks_are_compared_by_the_columns_that_both_use():
    """All distances of two blocks come from one comparison, at once both ways, and are those worked out pair by pair."""
    import numpy as np
    import pandas as pd

    from reviewspark.operators import resample as rs

    rnd = np.random.default_rng(8)
    dense = np.where(rnd.random((40, 60)) < 0.15, rnd.integers(1, 4, (40, 60)), 0).astype(float)
    dense[:, 3] = 1.0  # a column that all rows use
    dense[7] = 0.0
    dense[9] = dense[30] = dense[12]
    rows = pd.DataFrame({
        "id": [f"r{i:02}" for i in range(40)], "columns": [np.flatnonzero(v) for v in dense], "values": [v[v != 0] for v in dense],
    })
    a, b = rs._Sparse(rows.iloc[:25]), rs._Sparse(rows.iloc[20:])
    distance = ((dense[:25, None] - dense[None, 20:]) ** 2).sum(axis=2)
    rough = rs._squares(a, b)
    assert np.isinf(rough[[20, 21, 22, 23, 24], range(5)]).all()
    assert np.allclose(np.where(np.isinf(rough), distance, rough), distance)
    ids = rows["id"].tolist()
    for first, second, far, met in ((range(25), range(20, 40), distance, rs._best_of_block(a, b, 3, rough)),
                                    (range(20, 40), range(25), distance.T, rs._best_of_block(b, a, 3, rough.T))):
        want = []
        for x, i in enumerate(first):
            others = sorted((far[x, y], ids[j]) for y, j in enumerate(second) if i != j)[:3]
            want += [(ids[i], name, d) for d, name in others]
        assert met == want


def test_vectors_are_resampled_as_sparse_as_arrays(spark, monkeypatch):
    """Vectors give the rows that arrays give, without a value for every place; groups of blocks change no neighbour."""
    import numpy as np
    from pyspark.ml.linalg import DenseVector, SparseVector, Vectors

    draw = np.random.default_rng(4)
    points = draw.random((160, 50)) * (draw.random((160, 50)) < 0.1)
    points[5] = 0.0
    names = [(f"p{i:03d}", int(i >= 40)) for i in range(160)]
    arrays = spark.createDataFrame([(*n, v.tolist()) for n, v in zip(names, points)], "id string, label int, features array<double>")
    kinds = [Vectors.sparse(50, {j: v[j] for j in np.flatnonzero(v)}) if i % 3 else DenseVector(v) for i, v in enumerate(points)]
    vectors = spark.createDataFrame([(*n, v) for n, v in zip(names, kinds)], ["id", "label", "features"])
    want = {r.id: r.features for r in resample.resample(arrays).collect()}
    for block, group in ((2048, 16384), (9, 20)):
        monkeypatch.setattr(resample, "BLOCK_ROWS", block)
        monkeypatch.setattr(resample, "GROUP_ROWS", group)
        made = resample.resample(vectors).collect()
        assert {r.id for r in made} == want.keys() and len(made) == len(want)
        assert all(np.array_equal(r.features.toArray(), want[r.id]) for r in made)
        new = [r.features for r in made if r.id.startswith("synthetic_")]
        assert new and all(isinstance(v, SparseVector) and (v.values != 0).all() for v in new)
