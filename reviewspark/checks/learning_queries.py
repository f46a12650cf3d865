"""Text features, TF-IDF, classifiers and screening runs over the article table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..learning import evaluate
from ..learning.features import STUDY_TYPES, TextFeatureExtractor, text_and_features, text_features
from ..learning.models import ImportanceSelector, ResampledEstimator, ScreenClassifier
from ..learning.screener import load_model, predict_screener, save_model, screener_pipeline, train_screener, training_rows
from ..learning.tfidf import ENGLISH_STOP_WORDS, TfidfVectorizer, tfidf_vocab, vector_rows, vocabulary
from ..operators.filters import drop_empty_text
from ..operators.metrics import metric_summary
from ..plans import screen as plans
from ..session import checkpoint, scratch_path
from ..sources import tables
from ..sources.tables import EXCLUSION, INCLUSION
from .registry import CLEAN, LABELS_CTE, query, with_articles
from .table_queries import SCREENED_CTE

# counted in the test texts, next to terms that need quoting in a pattern
TERMS = ["the", "und", "de", "license", "meta-analysis"]
_NW = r"[^\p{L}\p{N}_]"


def _count_sql(text: str, term: str) -> str:
    """Whole-word count without look-around: doubled separators let neighbouring hits share none."""
    doubled = f"regexp_replace(lower({text}), '({_NW})', '\\1\\1', 'g')"
    quoted = term.replace("-", "--")
    return f"len(regexp_extract_all({doubled}, '(?:^|{_NW}){quoted}(?:{_NW}|$)'))"


BODY = "title || ' ' || abstract || ' ' || keywords"
STUDY_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(keywords), '{name.lower()}') THEN {code}" for name, code in STUDY_TYPES.items()
) + " END"
FREQ_SQL = ", ".join(f"{_count_sql('text', t)} AS \"{t}_freq\"" for t in TERMS)
FEATURES_CTE = f"""
features AS (SELECT entry_id, length(title) AS title_length, length(abstract) AS abstract_length,
  length(text) AS text_length, {FREQ_SQL}, TRY_CAST(year AS INT) AS year, {STUDY_SQL} AS study_type, text
  FROM (SELECT *, {BODY} AS text FROM articles))"""
NUMERIC = ["title_length", "abstract_length", "text_length", *[f"{t}_freq" for t in TERMS], "year", "study_type"]
_QUOTED = ", ".join(f'"{c}"' for c in NUMERIC)


@query("text_features", with_articles(f"SELECT entry_id, {_QUOTED} FROM features", FEATURES_CTE))
def features(spark, sf_dir):
    return text_features(tables.articles(spark, sf_dir), TERMS).select("entry_id", *NUMERIC)


@query(
    "text_and_features",
    with_articles(f"SELECT entry_id, md5(text) AS text_md5, {_QUOTED} FROM features", FEATURES_CTE),
)
def text_then_features(spark, sf_dir):
    texts, numbers = text_and_features(text_features(tables.articles(spark, sf_dir), TERMS))
    hashed = texts.select("entry_id", F.md5("text").alias("text_md5"))
    return hashed.join(numbers, "entry_id").select("entry_id", "text_md5", *NUMERIC)


@query(
    "text_feature_extractor",
    with_articles(
        """SELECT entry_id, i AS position, v[i + 1]::DOUBLE AS value FROM (
          SELECT entry_id, v, unnest(range(len(v))) AS i FROM (
            SELECT entry_id, [text_length, """ + ", ".join(f'"{t}_freq"' for t in TERMS) + "] AS v FROM features))",
        FEATURES_CTE,
    ),
)
def text_feature_extractor(spark, sf_dir):
    body = F.concat_ws(" ", *[tx.text(c) for c in ("title", "abstract", "keywords")])
    rows = tables.articles(spark, sf_dir).select("entry_id", body.alias("text"))
    vectors = TextFeatureExtractor(terms=TERMS).transform(rows)
    exploded = vectors.select("entry_id", F.posexplode(vector_to_array("text_features")).alias("position", "value"))
    return exploded.select("entry_id", F.col("position").cast("long").alias("position"), "value")


# -- tf-idf --------------------------------------------------------------------------------------------

STOPS_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
TFIDF_CTE = f"""
docs AS (SELECT entry_id, list_filter(string_split(clean, ' '), lambda w: length(w) >= 2 AND w NOT IN ({STOPS_SQL})) AS t
         FROM (SELECT entry_id, {CLEAN} AS clean FROM articles) WHERE clean <> ''),
terms AS (SELECT entry_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)),
            lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM docs),
counts AS MATERIALIZED (SELECT entry_id, term, count(*) AS n FROM terms GROUP BY ALL),
size AS (SELECT count(*) AS docs FROM docs),
vocab AS MATERIALIZED (SELECT term, count(*) AS df, sum(n)::BIGINT AS tf,
    ln((1.0 + any_value(docs)) / (1.0 + count(*))) + 1.0 AS idf
  FROM counts, size GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.85 * any_value(docs)
  ORDER BY tf DESC, term LIMIT 5000)"""


def cleaned(spark, sf_dir) -> DataFrame:
    return drop_empty_text(tables.articles(spark, sf_dir)).select("entry_id", "clean")


@query("tfidf_vocab", with_articles("SELECT term, df, tf, round(idf, 9) AS idf FROM vocab", TFIDF_CTE))
def vocab(spark, sf_dir):
    return tfidf_vocab(cleaned(spark, sf_dir)).select("term", "df", "tf", F.round("idf", 9).alias("idf"))


@query(
    "tfidf",
    with_articles(
        """SELECT entry_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY entry_id)), 6) AS weight
        FROM (SELECT entry_id, term, n * idf AS w FROM counts JOIN vocab USING (term))""",
        TFIDF_CTE,
    ),
)
def tfidf(spark, sf_dir):
    docs = cleaned(spark, sf_dir)
    model = TfidfVectorizer().fit(docs)
    rows = vector_rows(model.transform(docs), vocabulary(model))
    return rows.select("entry_id", "term", F.round("weight", 6).alias("weight"))


# -- classifiers -----------------------------------------------------------------------------------------


def labelled(spark, sf_dir) -> DataFrame:
    return training_rows(tables.articles(spark, sf_dir), tables.seed_labels(spark, sf_dir))


def vectorized(spark, sf_dir, output: str = "features") -> DataFrame:
    rows = labelled(spark, sf_dir)
    return checkpoint(TfidfVectorizer(outputCol=output).fit(rows).transform(rows).drop("clean", "text"))


LABELLED_CTE = f"""
{LABELS_CTE.strip()},
labelled AS (SELECT entry_id, label FROM (SELECT entry_id, {CLEAN} AS clean FROM articles) JOIN seed_labels USING (entry_id) WHERE clean <> '')"""
# the vocabulary of the labelled articles
LABELLED_VOCAB_CTE = TFIDF_CTE.replace(f"(SELECT entry_id, {CLEAN} AS clean FROM articles)", f"(SELECT entry_id, {CLEAN} AS clean FROM articles JOIN seed_labels USING (entry_id))")
_SCORED_SQL = "true AS consistent, true AS bounded"


def _consistent(prediction: str = "prediction", probability: str = "probability") -> list:
    """The decision follows from the probability, which is one."""
    p = F.col(probability)
    return [
        ((F.col(prediction) == 1) == (p > 0.5)).alias("consistent"), ((p >= 0) & (p <= 1)).alias("bounded"),
    ]


def _learned(scored: DataFrame, least: float) -> DataFrame:
    """Scored training rows, with whether the model gets at least the share ``least`` of them right."""
    flat = checkpoint(scored.select(
        "entry_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    ))
    right = flat.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return flat.select("entry_id", "label", *_consistent(), F.lit((right or 0.0) >= least).alias("learned"))


def _fit_and_score(kind: str):
    def run(spark, sf_dir):
        rows = vectorized(spark, sf_dir)
        return _learned(ScreenClassifier(kind=kind).fit(rows).transform(rows), 0.9)

    return run


LEARNED_SQL = with_articles(f"SELECT entry_id, label, {_SCORED_SQL}, true AS learned FROM labelled", LABELLED_CTE)
for _kind in ("random_forest", "logistic_regression", "svm"):
    query(_kind, LEARNED_SQL)(_fit_and_score(_kind))


@query(
    "feature_selection",
    with_articles(
        "SELECT entry_id, (SELECT count(*) FROM vocab)::INT AS n_before, true AS fewer, true AS kept_as_they_are FROM labelled",
        LABELLED_CTE, LABELLED_VOCAB_CTE,
    ),
)
def feature_selection(spark, sf_dir):
    """Fewer features are kept, with the values they had."""
    rows = vectorized(spark, sf_dir, "all_features")
    slicer = ImportanceSelector().fit(rows)
    selected = slicer.transform(rows)
    places = F.split(F.lit(",".join(map(str, slicer.getIndices()))), ",").cast("array<int>")
    # arrays are columns of their own: inside the comparison they would be made again for every place
    arrays = selected.select("entry_id", vector_to_array("all_features").alias("every"), vector_to_array("features").alias("kept"))
    return arrays.select(
        "entry_id", F.size("every").alias("n_before"), ((F.size("kept") < F.size("every")) & (F.size("kept") > 0)).alias("fewer"),
        (F.transform(places, lambda i: F.get("every", i)) == F.col("kept")).alias("kept_as_they_are"),
    )


@query("imbalance_pipeline", LEARNED_SQL)
def imbalance_pipeline(spark, sf_dir):
    rows = vectorized(spark, sf_dir)
    return _learned(ResampledEstimator(ScreenClassifier()).fit(rows).transform(rows), 0.9)


SCREENED_ARTICLES_SQL = f"SELECT entry_id, {_SCORED_SQL} FROM (SELECT entry_id, {CLEAN} AS clean FROM articles) WHERE clean <> ''"


@query("ensemble_model", with_articles(SCREENED_ARTICLES_SQL.replace(" FROM (", ", true AS mean_of_members FROM (")))
def ensemble_model(spark, sf_dir):
    """Soft voting of the three classifiers, fitted on labelled articles and applied to all."""
    model = train_screener(screener_pipeline("ensemble"), labelled(spark, sf_dir)).model
    scored = model.transform(cleaned(spark, sf_dir).withColumn("text", F.lit("")))
    share = lambda name: vector_to_array(name)[1]
    mean = sum(share(f"{m}_probability") for m in ("rf", "lr", "svm")) / 3
    flat = scored.select("entry_id", "prediction", share("probability").alias("probability"), mean.alias("mean"))
    return flat.select("entry_id", *_consistent(), (F.abs(F.col("probability") - F.col("mean")) < 1e-9).alias("mean_of_members"))


SUMMARY_SCHEMA = (
    "n_samples long, positive long, negative long, num_features int, feature_names array<string>, mean_cv_score double"
)


@query(
    "train_screener",
    with_articles(
        """SELECT count(*) AS n_samples, count_if(label = 1) AS positive, count_if(label = 0) AS negative,
          (SELECT count(*) FROM vocab)::INT AS num_features,
          (SELECT string_agg(term, '|' ORDER BY term) FROM (SELECT term FROM vocab ORDER BY term LIMIT 20)) AS first_terms,
          true AS bounded
        FROM labelled""",
        LABELLED_CTE, LABELLED_VOCAB_CTE,
    ),
)
def train(spark, sf_dir):
    """The summary of a training run with its cross-validation."""
    trained = train_screener(screener_pipeline(), labelled(spark, sf_dir), cv_folds=5)
    names = [part.split()[0] for part in SUMMARY_SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple(trained.summary[n] for n in names)], SUMMARY_SCHEMA)
    bounded = F.col("mean_cv_score").between(0.5, 1.0).alias("bounded")
    return row.select(*names[:4], F.array_join("feature_names", "|").alias("first_terms"), bounded)


@query("predict_screener", with_articles(SCREENED_ARTICLES_SQL))
def predict(spark, sf_dir):
    trained = train_screener(screener_pipeline("random_forest"), labelled(spark, sf_dir))
    articles = tables.articles(spark, sf_dir).select("entry_id", "title", "abstract", "keywords")
    return predict_screener(trained.model, articles).select("entry_id", *_consistent())


@query("model_store", with_articles(SCREENED_ARTICLES_SQL.replace(_SCORED_SQL, "true AS same_score")))
def model_store(spark, sf_dir):
    """Scores of a saved and loaded screener are those of the one in memory, and an unfitted one is saved as well."""
    path = scratch_path(spark, "model")
    pipeline = screener_pipeline("logistic_regression", resampling="combined", text_features=True)
    pipeline.write().overwrite().save(f"{path}-unfitted")
    trained = train_screener(Pipeline.load(f"{path}-unfitted"), labelled(spark, sf_dir))
    save_model(trained.model, path)
    articles = tables.articles(spark, sf_dir).select("entry_id", "title", "abstract", "keywords")
    before = predict_screener(trained.model, articles).select("entry_id", F.col("probability").alias("before"))
    after = predict_screener(load_model(spark, path), articles).select("entry_id", F.col("probability").alias("after"))
    return before.join(after, "entry_id").select("entry_id", (F.col("before") == F.col("after")).alias("same_score"))


@query(
    "cross_validate",
    "SELECT unnest(['f1', 'precision', 'recall', 'auc']) AS metric, CAST(5 AS BIGINT) AS folds, true AS recomputed, true AS better_than_chance",
)
def cross_validate(spark, sf_dir):
    """The metrics of every fold are worked out again from the scores of its rows."""
    rows = vectorized(spark, sf_dir)
    model = ScreenClassifier(kind="logistic_regression")
    values = evaluate.cross_validate(model, rows)
    folds, k = evaluate.folded(rows)
    scored = checkpoint(evaluate.out_of_fold(model, folds, k))
    hit = lambda p, y: F.count_if((F.col("prediction") == p) & (F.col("label") == y))
    cells = scored.groupBy("fold").agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    ones, zeros = (scored.where(F.col("label") == y).select("fold", F.col("probability").alias(f"p{y}")) for y in (1, 0))
    # the area under the curve as the share of pairs in the right order, within one fold of the labelled rows
    wins = F.when(F.col("p1") > F.col("p0"), 1.0).when(F.col("p1") == F.col("p0"), 0.5).otherwise(0.0)
    auc = ones.join(zeros, "fold").groupBy("fold").agg(F.avg(wins).alias("auc"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    plain = {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall), "auc": F.col("auc")}
    again = cells.join(auc, "fold").select("fold", F.explode(F.create_map(*[x for n, c in plain.items() for x in (F.lit(n), c)])).alias("metric", "again"))
    met = values.join(again, ["fold", "metric"])
    chance = F.avg("value") > 0.5
    return met.groupBy("metric").agg(F.count("*").alias("folds"), F.bool_and(F.abs(F.col("value") - F.col("again")) < 1e-9).alias("recomputed"), chance.alias("better_than_chance"))


@query(
    "learning_curve",
    with_articles(
        """SELECT unnest(list_distinct(list_transform(range(10), lambda i: greatest(1, floor((0.1 + i * 0.1) * least)::INT)))) AS train_size,
          true AS bounded
        FROM (SELECT n - ceil(n / 5.0)::INT AS least FROM (SELECT count(*) AS n FROM labelled))""",
        LABELLED_CTE,
    ),
)
def learning_curve(spark, sf_dir):
    rows = vectorized(spark, sf_dir)
    curve = evaluate.learning_curve(ScreenClassifier(kind="logistic_regression"), rows)
    bounded = [F.isnan(c) | F.col(c).between(0, 1) for c in ("train_mean", "test_mean")]
    return curve.select("train_size", (bounded[0] & bounded[1]).alias("bounded"))


_GRID_SQL = "SELECT '{{\"c\": ' || c || '}}' AS params, true AS ranked, true AS bounded FROM (SELECT unnest({0}) AS c)"


def _ranked(table: DataFrame) -> DataFrame:
    """Every combination with whether its rank follows from its score. One row per combination."""
    rows = table.orderBy("rank").collect()
    scores = [r["mean_score"] for r in rows]
    out = [(r["params"], i == 0 or scores[i - 1] >= r["mean_score"], 0 <= r["mean_score"] <= 1) for i, r in enumerate(rows)]
    return table.sparkSession.createDataFrame(out, "params string, ranked boolean, bounded boolean")


@query("grid_search", _GRID_SQL.format("['0.1', '1.0', '10.0']"))
def grid_search(spark, sf_dir):
    model = ScreenClassifier(kind="logistic_regression")
    _, table = evaluate.grid_search(model, vectorized(spark, sf_dir), {model.c: [0.1, 1.0, 10.0]})
    return _ranked(table)


@query("random_search", "SELECT true AS ranked, true AS bounded, CAST(20 AS BIGINT) AS combinations")
def random_search(spark, sf_dir):
    model = ScreenClassifier(kind="logistic_regression")
    choices = {model.c: [10.0 ** (k / 8) for k in range(-16, 17)]}
    _, table = evaluate.random_search(model, vectorized(spark, sf_dir), choices)
    rows = _ranked(table)
    return rows.agg(F.bool_and("ranked").alias("ranked"), F.bool_and("bounded").alias("bounded"), F.count_distinct("params").alias("combinations"))


# -- screening runs --------------------------------------------------------------------------------------


@query("screen_rules", with_articles("SELECT entry_id, decision, reason, confidence FROM screened", SCREENED_CTE))
def screen_rules(spark, sf_dir):
    run = plans.screen(tables.articles(spark, sf_dir), EXCLUSION, INCLUSION)
    return run.results.select("entry_id", "decision", "reason", "confidence")


RUN_SQL = with_articles(
    """SELECT entry_id, CASE WHEN decision <> 'uncertain' THEN decision END AS by_rule,
      CASE WHEN decision <> 'uncertain' THEN reason END AS rule_reason, decision = 'uncertain' AS by_model, true AS consistent
    FROM screened""",
    SCREENED_CTE,
)


def _run_rows(run: plans.Screened) -> DataFrame:
    """Decisions of the rules, and whether those of the model follow from its probabilities."""
    scored, p = F.col("ml_probability").isNotNull(), F.col("ml_probability")
    follows = (F.col("decision") == "include") == (p > 0.5)
    return run.results.select(
        "entry_id", F.when(~scored, F.col("decision")).alias("by_rule"), F.when(~scored, F.col("reason")).alias("rule_reason"),
        scored.alias("by_model"), F.when(scored, follows & p.between(0, 1)).otherwise(True).alias("consistent"),
    )


@query("screen", RUN_SQL)
def screen(spark, sf_dir):
    run = plans.screen(tables.articles(spark, sf_dir), EXCLUSION, INCLUSION, tables.seed_labels(spark, sf_dir))
    return _run_rows(run)


@query("screen_enhanced", RUN_SQL)
def screen_enhanced(spark, sf_dir):
    run = plans.screen_enhanced(
        tables.articles(spark, sf_dir), EXCLUSION, INCLUSION, tables.seed_labels(spark, sf_dir), strategy="combined", text_features=True,
    )
    return _run_rows(run)


@query(
    "screen_committee",
    with_articles("SELECT count(*) AS to_label, true AS open, true AS votes_differ_most_first FROM (SELECT 1 FROM screened WHERE decision = 'uncertain' LIMIT 10)", SCREENED_CTE),
)
def screen_committee(spark, sf_dir):
    """The batch to label by a committee: open articles, those first whose members' votes differ most."""
    run = plans.screen(tables.articles(spark, sf_dir), EXCLUSION, INCLUSION, tables.seed_labels(spark, sf_dir), strategy="committee")
    batch = run.to_label.select("entry_id", "disagreement").join(run.rule_results.select("entry_id", "decision"), "entry_id")
    return batch.agg(
        F.count("*").alias("to_label"), F.bool_and(F.col("decision") == "uncertain").alias("open"),
        F.bool_and(F.col("disagreement").between(0, 0.25)).alias("votes_differ_most_first"),
    )
