"""Training, scoring, saving and loading of article screeners."""

from __future__ import annotations

import math
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.filters import drop_empty_text
from ..operators.rules import apply_predictions, training_guards
from ..session import checkpoint
from . import evaluate
from .features import TextFeatureExtractor
from .models import Ensemble, ImportanceSelector, ResampledEstimator, ScreenClassifier, member_votes
from .tfidf import TfidfVectorizer, vocabulary

ROWS_PER_PARTITION = 4096
NAMES_SHOWN = 20
_OWN = (TfidfVectorizer, StandardScaler, VectorAssembler, ImportanceSelector, ScreenClassifier, Ensemble, ResampledEstimator)
MODELS = ("random_forest", "logistic_regression", "svm", "ensemble", "weighted_ensemble")


def screener_pipeline(
    model: str = "random_forest", select_features: bool = False, resampling: str | None = None,
    text_features: bool = False, **options,
) -> Pipeline:
    """Text vectorizer, optional feature selection, and the chosen classifier (optionally on balanced rows).

    With ``text_features`` the text's length and term counts, scaled to unit variance, stand next to the term weights.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, expected one of {', '.join(MODELS)}")
    if model in ("ensemble", "weighted_ensemble"):
        voting = "weighted" if model == "weighted_ensemble" else options.pop("voting", "soft")
        classifier: Estimator = Ensemble(voting=voting, **options)
    else:
        classifier = ScreenClassifier(kind=model, **options)
    if resampling:
        classifier = ResampledEstimator(classifier, resampling)
    vectors = "all_features" if select_features else "features"
    terms = "term_features" if text_features else vectors
    stages: list = [TextFeatureExtractor(inputCol="text")] if text_features else []
    stages.append(TfidfVectorizer(outputCol=terms))
    if text_features:
        stages += [
            StandardScaler(inputCol="text_features", outputCol="scaled_features"),
            VectorAssembler(inputCols=[terms, "scaled_features"], outputCol=vectors),
        ]
    if select_features:
        stages.append(ImportanceSelector())
    return Pipeline(stages=[*stages, classifier])


def _with_text(articles: DataFrame) -> DataFrame:
    """Adds the text that lengths and term counts are taken from, as it is written."""
    return articles.withColumn("text", F.concat_ws(" ", *[tx.text(c) for c in ("title", "abstract", "keywords")]))


def training_rows(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled articles with cleaned text, in a partitioning and order that depend on the ids only."""
    narrow = articles.select("entry_id", "title", "abstract", "keywords").join(labels.select("entry_id", "label"), "entry_id")
    parts = max(1, math.ceil(drop_empty_text(narrow).count() / ROWS_PER_PARTITION))
    # texts are cleaned after the shuffles, which then carry them once
    rows = _with_text(drop_empty_text(narrow.repartition(parts, "entry_id"))).select("entry_id", "clean", "text", "label")
    return checkpoint(rows.sortWithinPartitions("entry_id"))


@dataclass
class Trained:
    model: PipelineModel
    summary: dict
    """n_samples, positive, negative, num_features, feature_names and the mean cross-validation score."""


def _prepared(pipeline: Pipeline, rows: DataFrame) -> tuple[list[Transformer], Pipeline, DataFrame]:
    """The stages at the head that learn nothing, the others, and the rows as the latter need them, worked out once for all fits."""
    stages = pipeline.getStages()
    count = next((i for i, stage in enumerate(stages) if not isinstance(stage, Transformer)), len(stages))
    head, rest = stages[:count], stages[count:]
    read = {stage.getOrDefault("inputCol") for stage in rest if stage.hasParam("inputCol") and stage.isDefined("inputCol")}
    spare = ["text"] if "text" not in read and all(isinstance(stage, _OWN) for stage in rest) else []
    if not head:
        return head, pipeline, rows.drop(*spare)
    return head, Pipeline(stages=rest), checkpoint(PipelineModel(head).transform(rows).drop(*spare))


def train_screener(pipeline: Pipeline, rows: DataFrame, cv_folds: int = 0) -> Trained:
    """Fit on labelled rows. With ``cv_folds`` and ten rows or more the F1 score is cross-validated first."""
    sizes = training_guards(rows)
    head, rest, rows = _prepared(pipeline, rows)
    score = 1.0  # fixed value: stands for a score that was not measured
    if cv_folds and sizes["n_samples"] >= 10:
        folds = evaluate.cross_validate(rest, rows, cv_folds, n=sizes["n_samples"])
        score = folds.filter(F.col("metric") == "f1").agg(F.avg("value")).collect()[0][0]
    model = PipelineModel([*head, *rest.fit(rows).stages])
    names = vocabulary(model)
    summary = {
        **sizes, "num_features": len(names), "feature_names": names[:NAMES_SHOWN], "mean_cv_score": float(score)
    }
    return Trained(model, summary)


def predict_screener(model: PipelineModel | None, articles: DataFrame, details: bool = False) -> DataFrame:
    """Articles with text, plus ``prediction`` and the include ``probability``. One narrow pass.

    With ``details`` also the length of the feature vector (features_norm) and, for an ensemble, the members' votes.
    """
    if model is None:
        raise ValueError("Model must be trained before making predictions")
    names = ("prediction", "probability", "features_norm", "votes") if details else ("prediction", "probability")
    keep = [c for c in articles.columns if c not in names]
    scored = model.transform(_with_text(drop_empty_text(articles.select(*keep))))
    columns = [F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability")]
    if details:
        squares = F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda s, x: s + x * x)
        columns.append(F.sqrt(squares).alias("features_norm"))
        if any(c.endswith("_prediction") for c in scored.columns):
            columns.append(member_votes(scored.columns).alias("votes"))
    return scored.select(*keep, *columns)


def decide(results: DataFrame, scored: DataFrame) -> DataFrame:
    """Rule results with the uncertain articles decided by their scores (entry_id, ord, prediction, probability).

    Articles without a score, those without words among them, stay uncertain. Only the scored ids are joined.
    """
    uncertain = results.filter(F.col("decision") == "uncertain")
    scores = scored.select("entry_id", "ord", F.col("prediction").alias("_p"), F.col("probability").alias("_s"))
    decided = results.filter(F.col("decision") != "uncertain").withColumn("ml_probability", F.lit(None).cast("double"))
    return decided.unionByName(apply_predictions(uncertain.join(scores, ["entry_id", "ord"], "left"), "_p", "_s"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """A saved screener; the error names the missing model rather than a missing file."""
    try:
        return PipelineModel.load(path)
    except (Py4JJavaError, PySparkException) as error:
        raise ValueError(f"Model must be trained before making predictions (nothing usable at {path})") from error
