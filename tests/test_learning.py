"""Features, TF-IDF and classifiers on a small set with two vocabularies."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reviewspark.learning import evaluate, screener
from reviewspark.learning.features import TextFeatureExtractor, text_and_features, text_features
from reviewspark.learning.models import Ensemble, ImportanceSelector, ResampledEstimator, ScreenClassifier
from reviewspark.learning.tfidf import ENGLISH_STOP_WORDS, TfidfVectorizer, tfidf_vocab, vector_rows, vocabulary
from reviewspark.operators.metrics import metric_summary
from reviewspark.plans import screen as plans
from reviewspark.session import checkpoint

GOOD = "trial randomized placebo dose survival arm blinded outcome".split()
BAD = "mouse cell culture genome protein pathway mutation assay".split()
BOTH = "study the results of patients and methods data".split()
SMALL = dict(numTrees=10, maxDepth=5)


@pytest.fixture(scope="module")
def articles(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        good = i % 3 == 0
        words = rnd.choices(GOOD if good else BAD, k=8) + rnd.choices(BOTH, k=8)
        rnd.shuffle(words)
        rows.append((f"e{i}", i, " ".join(words[:5]), " ".join(words[5:]), "", "2001", int(good), "J", "A, B"))
    df = spark.createDataFrame(
        rows, "entry_id string, ord long, title string, abstract string, keywords string, year string, label int, "
        "journal string, author string",
    )
    return checkpoint(df.repartition(3))


@pytest.fixture(scope="module")
def labels(articles):
    return articles.filter("ord < 60").select("entry_id", "label")


@pytest.fixture(scope="module")
def rows(articles, labels):
    return screener.training_rows(articles, labels)


@pytest.fixture(scope="module")
def vectors(rows):
    return checkpoint(TfidfVectorizer(minDF=2).fit(rows).transform(rows))


def check_scores(scored, n, least_auc=0.9):
    got = scored.select("label", "prediction", vector_to_array("probability")[1].alias("p")).collect()
    assert len(got) == n and all(0 <= r.p <= 1 for r in got)
    assert all(r.prediction in (0, 1) for r in got)
    pos, neg = [r.p for r in got if r.label == 1], [r.p for r in got if r.label == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > least_auc


def test_tfidf_weights(spark):
    texts = ["the red fox red fox runs", "red dog runs far", "a fox x", "blue"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "entry_id string, clean string")
    terms = []
    for t in texts:
        w = [x for x in t.split() if len(x) > 1 and x not in ENGLISH_STOP_WORDS]
        terms.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for doc in terms for t in set(doc))
    tf = Counter(t for doc in terms for t in doc)
    kept = {t for t in df if 2 <= df[t] <= 0.85 * 4}
    got = {r.term: (r.df, r.tf) for r in tfidf_vocab(docs).collect()}
    assert got == {t: (df[t], tf[t]) for t in kept}
    assert [r.term for r in tfidf_vocab(docs, max_features=2).collect()] == sorted(kept, key=lambda t: (-tf[t], t))[:2]
    model = TfidfVectorizer().fit(docs)
    assert vocabulary(model) == sorted(kept)
    expected = {}
    for i, doc in enumerate(terms):
        weights = {t: c * (math.log(5 / (1 + df[t])) + 1) for t, c in Counter(doc).items() if t in kept}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        expected.update({(str(i), t): w / norm for t, w in weights.items()})
    found = {(r.entry_id, r.term): r.weight for r in vector_rows(model.transform(docs), vocabulary(model)).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    with pytest.raises(ValueError, match="vocabulary"):
        TfidfVectorizer().fit(docs.filter("entry_id = '3'"))


def test_pairs_of_rare_words_are_not_counted_but_none_is_lost(spark):
    """Only pairs of words as frequent as the last one kept are counted, and the vocabulary is that of counting all."""
    from reviewspark.learning import tfidf

    rnd = random.Random(9)
    texts = [(" ".join(rnd.choices(["aa", "bb", "cc"], k=6) + [f"rare{rnd.randrange(40)}" for _ in range(4)]),) for _ in range(60)]
    docs = spark.createDataFrame([*texts, ("",), (None,)], "clean string").repartition(3)
    for most in (3, 7, 5000):
        tf, df = Counter(), Counter()
        for (text,) in texts:
            words = text.split()
            terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
            tf.update(terms)
            df.update(set(terms))
        kept = sorted((t for t in tf if 2 <= df[t] <= 0.9 * 62), key=lambda t: (-tf[t], t))[:most]
        got = [(r.term, r.df, r.tf) for r in tfidf_vocab(docs, max_features=most, max_df=0.9).collect()]
        assert got == [(t, df[t], tf[t]) for t in kept]
    words = spark.createDataFrame([(["x", "y", "x", "y", "z"],), (["z", "x", "y"],)], "words array<string>").coalesce(1)
    import pyarrow as pa

    of = pa.array(["x", "y"])
    only = words.mapInArrow(lambda batches: tfidf._pairs(batches, of), "term string, d long, f long")
    assert sorted(tuple(r) for r in only.collect()) == [("x y", 2, 3), ("y x", 1, 1)]


def test_text_features(spark, tmp_path):
    rows = [("a", "A Trial", "of treatment; trials", "Cohort, review", "2001"), ("b", None, "", "x", "in press")]
    df = spark.createDataFrame(rows, "entry_id string, title string, abstract string, keywords string, year string")
    feats = text_features(df)
    got = {r.entry_id: r.asDict() for r in feats.collect()}
    a, b = got["a"], got["b"]
    assert (a["title_length"], a["abstract_length"], a["text_length"]) == (7, 20, 43)
    assert (a["trial_freq"], a["treatment_freq"], a["review_freq"], a["meta-analysis_freq"]) == (1, 1, 1, 0)
    assert (a["year"], a["study_type"], b["year"], b["study_type"], b["title_length"]) == (2001, 3, None, None, 0)
    texts, numbers = text_and_features(feats)
    assert texts.columns == ["entry_id", "text"] and "title" not in numbers.columns
    extractor = TextFeatureExtractor(terms=["trial", "x"])
    extractor.write().overwrite().save(str(tmp_path / "t"))
    loaded = TextFeatureExtractor.load(str(tmp_path / "t"))
    vec = loaded.transform(feats.select("entry_id", "text")).orderBy("entry_id").collect()
    assert [list(r.text_features) for r in vec] == [[43.0, 1.0, 0.0], [3.0, 0.0, 1.0]]


@pytest.mark.parametrize("kind", ["random_forest", "logistic_regression", "svm"])
def test_classifiers_separate_the_vocabularies(vectors, kind):
    options = SMALL if kind == "random_forest" else {}
    model = ScreenClassifier(kind=kind, **options).fit(vectors)
    check_scores(model.transform(vectors), 60)


def test_unknown_names_are_errors(vectors):
    with pytest.raises(ValueError):
        ScreenClassifier(kind="tree").fit(vectors)
    with pytest.raises(ValueError):
        screener.screener_pipeline("nothing")
    with pytest.raises(ValueError):
        Ensemble(voting="loud")
    with pytest.raises(ValueError, match="both positive"):
        ScreenClassifier(kind="svm").fit(vectors.filter("label = 1"))


def test_importance_selector_keeps_the_heavier_features(vectors):
    renamed = vectors.withColumnRenamed("features", "all_features")
    slicer = ImportanceSelector(numTrees=10, maxDepth=5).fit(renamed)
    n = len(renamed.first()["all_features"])
    assert 0 < len(slicer.getIndices()) < n
    assert len(slicer.transform(renamed).first()["features"]) == len(slicer.getIndices())


def test_ensembles(vectors, tmp_path):
    members = [("rf", ScreenClassifier(**SMALL)), ("lr", ScreenClassifier(kind="logistic_regression"))]
    for voting in ("soft", "hard", "weighted"):
        weights = [3.0, 1.0] if voting == "weighted" else None
        model = Ensemble(members, voting, weights).fit(vectors)
        scored = model.transform(vectors)
        check_scores(scored, 60, 0.8)
        one = scored.first()
        shares = [one["rf_probability"][1], one["lr_probability"][1]]
        expected = {
            "soft": sum(shares) / 2,
            "hard": (one["rf_prediction"] + one["lr_prediction"]) / 2,
            "weighted": 0.75 * shares[0] + 0.25 * shares[1],
        }[voting]
        assert abs(one["probability"][1] - expected) < 1e-12


def test_resampled_estimator(vectors):
    model = ResampledEstimator(ScreenClassifier(kind="logistic_regression")).fit(vectors)
    check_scores(model.transform(vectors), 60)


def test_train_predict_save_load(spark, articles, rows, tmp_path):
    pipeline = Pipeline(stages=[TfidfVectorizer(outputCol="all_features"), ImportanceSelector(numTrees=10, maxDepth=5),
                                ScreenClassifier(**SMALL)])
    trained = screener.train_screener(pipeline, rows, cv_folds=2)
    assert trained.summary["n_samples"] == 60 and trained.summary["positive"] == 20
    assert 0.5 < trained.summary["mean_cv_score"] <= 1 and len(trained.summary["feature_names"]) == 20
    scored = screener.predict_screener(trained.model, articles)
    path = str(tmp_path / "model")
    screener.save_model(trained.model, path)
    again = screener.predict_screener(screener.load_model(spark, path), articles)
    pick = lambda df: sorted((r.entry_id, r.prediction, r.probability) for r in df.collect())
    assert pick(scored) == pick(again) and len(pick(scored)) == 120
    with pytest.raises(ValueError, match="must be trained"):
        screener.load_model(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError, match="must be trained"):
        screener.predict_screener(None, articles)


def test_same_model_after_repartition(articles, labels):
    pipeline = Pipeline(stages=[TfidfVectorizer(), ScreenClassifier(**SMALL)])
    scores = []
    for parts in (2, 5):
        spread = articles.repartition(parts)
        model = pipeline.fit(screener.training_rows(spread, labels))
        scores.append(sorted((r.entry_id, r.probability) for r in screener.predict_screener(model, spread).collect()))
    assert scores[0] == scores[1]


def test_saved_ensemble(spark, articles, rows, tmp_path):
    members = [("lr", ScreenClassifier(kind="logistic_regression")), ("rf", ScreenClassifier(**SMALL))]
    model = Pipeline(stages=[TfidfVectorizer(), Ensemble(members)]).fit(rows)
    screener.save_model(model, str(tmp_path / "e"))
    loaded = screener.load_model(spark, str(tmp_path / "e"))
    a, b = (screener.predict_screener(m, articles).orderBy("entry_id").collect() for m in (model, loaded))
    assert [(r.entry_id, r.probability) for r in a] == [(r.entry_id, r.probability) for r in b]


def test_cross_validation_and_search(vectors):
    model = ScreenClassifier(kind="logistic_regression")
    folds = evaluate.cross_validate(model, vectors, n_folds=3)
    assert folds.count() == 12 and folds.filter("metric = 'auc' and value > 0.5").count() == 3
    assert {r.metric for r in metric_summary(folds).collect()} == {"f1", "precision", "recall", "auc"}
    best, table = evaluate.grid_search(model, vectors, {model.c: [0.01, 10.0]}, n_folds=2)
    ranked = [r.mean_score for r in table.orderBy("rank").collect()]
    assert len(ranked) == 2 and ranked == sorted(ranked, reverse=True) and best["score"] == ranked[0]
    _, drawn = evaluate.random_search(model, vectors, {model.c: [0.01, 0.1, 1.0, 10.0]}, n_iter=2, n_folds=2)
    assert drawn.count() == 2


def test_learning_curve(vectors):
    model = ScreenClassifier(kind="logistic_regression")
    curve = evaluate.learning_curve(model, vectors, shares=[0.4, 1.0], n_folds=2).orderBy("train_size").collect()
    assert [r.train_size for r in curve] == [12, 30]
    assert all(0 <= r.train_mean <= 1 and 0 <= r.test_mean <= 1 for r in curve)
    assert [len(evaluate.curve_shares(n)) for n in (10, 50, 500)] == [3, 5, 10]


def test_screening_run(articles, labels):
    only_rules = plans.screen(articles, ["mouse"], ["placebo"])
    assert only_rules.predictions is None and only_rules.results.count() == 120
    pipeline = Pipeline(stages=[TfidfVectorizer(), ScreenClassifier(kind="logistic_regression")])
    run = plans.screen(articles, ["mouse"], ["placebo"], labels, pipeline, strategy="combined", n_samples=5)
    counts = {r.decision: r.n for r in run.final_counts().collect()}
    assert counts["uncertain"] == 0 and sum(counts.values()) == 120
    open_ids = {r.entry_id for r in only_rules.results.filter("decision = 'uncertain'").collect()}
    assert {r.entry_id for r in run.predictions.collect()} == open_ids
    assert {r.entry_id for r in run.to_label.collect()} <= open_ids and run.to_label.count() == min(5, len(open_ids))
    right = run.results.filter("ml_probability is not null")
    agree = right.filter((F.col("decision") == "include").cast("int") == F.col("label")).count()
    assert agree >= 0.8 * right.count()


def test_enhanced_screening_run(articles, labels):
    run = plans.screen_enhanced(articles, ["mouse"], [], labels, cv_folds=0, strategy="diversity", **SMALL)
    assert run.results.filter("decision = 'uncertain'").count() == 0
    assert run.trained.summary["n_samples"] == 60


def test_unfitted_pipelines_with_estimators_inside_are_saved(spark, tmp_path):
    ensemble = Ensemble([("a", ScreenClassifier(kind="logistic_regression", c=0.5)), ("b", ScreenClassifier(kind="svm"))], voting="hard", threshold=0.4)
    pipeline = Pipeline(stages=[TfidfVectorizer(), ResampledEstimator(ensemble, "over", oversampling_ratio=0.7, seed=5)])
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    balanced = Pipeline.load(str(tmp_path / "p")).getStages()[1]
    assert (balanced.getOrDefault("strategy"), balanced.getOrDefault("overRatio"), balanced.getOrDefault("seed")) == ("over", 0.7, 5)
    inner = balanced.getOrDefault("estimator")
    assert (inner.getOrDefault("voting"), inner.getOrDefault("threshold"), inner.isSet("weights")) == ("hard", 0.4, False)
    (a, first), (b, second) = inner.getOrDefault("members")
    assert (a, b, first.getOrDefault("kind"), first.getOrDefault("c"), second.getOrDefault("kind")) == ("a", "b", "logistic_regression", 0.5, "svm")
    # a parameter grid reaches the members
    changed = balanced.copy({first.c: 9.0})
    assert dict(changed.getOrDefault("estimator").getOrDefault("members"))["a"].getOrDefault("c") == 9.0
    assert first.getOrDefault("c") == 0.5


def test_committee_and_model_change_batches(articles, labels):
    small = Ensemble([("a", ScreenClassifier(kind="logistic_regression")), ("b", ScreenClassifier(kind="logistic_regression", c=1e-6))])
    pipeline = Pipeline(stages=[TfidfVectorizer(), small])
    run = plans.screen(articles, ["mouse"], [], labels, pipeline, strategy="committee", n_samples=4)
    picked = run.to_label.collect()
    assert len(picked) == 4 and [r.disagreement for r in picked] == sorted((r.disagreement for r in picked), reverse=True)
    assert all(r.disagreement == pytest.approx(statistics.pvariance(r.votes)) for r in picked)
    change = plans.screen(articles, ["mouse"], [], model=run.trained.model, strategy="model_change", n_samples=3).to_label.collect()
    assert all(r.expected_change == pytest.approx(r.probability * (1 - r.probability) * r.features_norm) for r in change)
    with pytest.raises(ValueError, match="unknown strategy"):
        plans.screen(articles, [], [], labels, pipeline, strategy="nearest")
    with pytest.raises(ValueError, match="members vote"):
        plain = Pipeline(stages=[TfidfVectorizer(), ScreenClassifier(kind="logistic_regression")])
        plans.screen(articles, ["mouse"], [], labels, plain, strategy="committee")


def test_term_weights_work_through_batches_of_texts(spark, tmp_path):
    """One model counts words and pairs of any script, of blank and missing texts too, and is saved with its weights."""
    from reviewspark.learning.tfidf import TermWeights

    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["über", "été", "x", "the", "naïve", "中文", "red", "dog"], k=9)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "entry_id string, clean string").repartition(3)
    model = TfidfVectorizer(minDF=1, maxDF=1.0).fit(docs)
    assert isinstance(model, TermWeights)
    model.write().overwrite().save(str(tmp_path / "m"))
    terms, idf = vocabulary(model), dict(zip(vocabulary(model), model.getOrDefault("idf")))
    for m in (model, TermWeights.load(str(tmp_path / "m"))):
        got = {r.entry_id: r.features for r in m.transform(docs).collect()}
        for i, text in enumerate(texts):
            words = [w for w in (text or "").split() if len(w) > 1 and w != "the"]
            want = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in want.items())) or 1.0
            found = dict(zip([terms[j] for j in got[str(i)].indices], got[str(i)].values))
            assert got[str(i)].size == len(terms) and found.keys() == want.keys()
            assert all(abs(found[t] - n * idf[t] / norm) < 1e-12 for t, n in want.items())


def test_stages_that_learn_nothing_run_once_for_all_folds(rows, monkeypatch):
    """Term counts do not depend on the fold: they are worked out before the fits, and the model still has them."""
    seen = []
    plain = TextFeatureExtractor._transform
    monkeypatch.setattr(TextFeatureExtractor, "_transform", lambda self, df: seen.append(1) or plain(self, df))
    trained = screener.train_screener(screener.screener_pipeline("logistic_regression", text_features=True), rows, cv_folds=3)
    assert len(seen) == 1 and isinstance(trained.model.stages[0], TextFeatureExtractor)
    assert 0.5 < trained.summary["mean_cv_score"] <= 1 and trained.summary["num_features"] > 0
    check_scores(trained.model.transform(rows), 60)


def test_selected_features_are_compared_with_arrays_made_once(spark, sf_dir):
    from reviewspark.checks import learning_queries as lq

    plan = lq.feature_selection(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    compared = next(line for line in plan.splitlines() if "kept_as_they_are" in line)
    assert "transform(" in compared and "UDF" not in compared
