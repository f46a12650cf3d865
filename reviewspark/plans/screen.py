"""Screening stage: rules, then a classifier for what the rules leave open, then the next batch to label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from ..learning.screener import (
    Trained,
    decide,
    predict_screener,
    screener_pipeline,
    train_screener,
    training_rows,
)
from ..operators import active, rules
from ..session import checkpoint


@dataclass
class Screened:
    results: DataFrame
    """Every article with decision, reason, confidence and ml_probability."""
    rule_results: DataFrame
    predictions: DataFrame | None = None
    to_label: DataFrame | None = None
    trained: Trained | None = None

    def final_counts(self) -> DataFrame:
        return rules.decision_counts(self.results)


STRATEGIES = ("uncertainty", "diversity", "combined", "committee", "model_change")


def select_to_label(
    predictions: DataFrame, strategy: str, n: int = active.BATCH_SIZE, vector: str | None = None
) -> DataFrame:
    """The next batch to label. Committee needs the members' ``votes``, model_change uses ``features_norm`` if it is there."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(STRATEGIES)}")
    if strategy == "uncertainty":
        return active.select_uncertainty(predictions, n)
    if strategy == "diversity":
        return active.select_diversity(predictions, n, vector)
    if strategy == "committee":
        if "votes" not in predictions.columns:
            raise ValueError("the committee strategy needs an ensemble, whose members vote")
        return active.select_disagreement(predictions, n)
    if strategy == "model_change":
        return active.select_model_change(predictions, n, "features_norm" if "features_norm" in predictions.columns else None)
    return active.select_combined(predictions, n, vector)


def screen(
    articles: DataFrame,
    exclusion: Sequence[str],
    inclusion: Sequence[str],
    labels: DataFrame | None = None,
    pipeline: Pipeline | None = None,
    cv_folds: int = 0,
    strategy: str = "uncertainty",
    n_samples: int = active.BATCH_SIZE,
    model: PipelineModel | None = None,
) -> Screened:
    """Rules decide first. With seed labels (or a trained ``model``) the uncertain articles are scored.

    The rules and the model see every article once; ids, scores and votes are written down, and results, predictions and
    the batch to label are made from them.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(STRATEGIES)}")
    by_rule = rules.rule_screen(articles, exclusion, inclusion)
    trained = None
    if labels is not None:
        rows = training_rows(articles, labels)
        default = screener_pipeline("ensemble") if strategy == "committee" else screener_pipeline()
        trained = train_screener(pipeline or default, rows, cv_folds)
        model = trained.model
    if model is None:
        return Screened(by_rule, by_rule)
    uncertain = rules.uncertain_subset(by_rule)
    scored = predict_screener(model, uncertain.select("entry_id", "ord", "title", "abstract", "keywords"), details=True)
    scored = checkpoint(scored.drop("title", "abstract", "keywords"))
    shown = scored.select("entry_id", "ord", "prediction", "probability")
    return Screened(decide(by_rule, scored), by_rule, shown, select_to_label(scored, strategy, n_samples), trained)


def screen_enhanced(
    articles: DataFrame,
    exclusion: Sequence[str],
    inclusion: Sequence[str],
    labels: DataFrame,
    model: str = "random_forest",
    use_ensemble: bool = False,
    handle_imbalance: bool = True,
    select_features: bool = True,
    strategy: str = "uncertainty",
    cv_folds: int = 5,
    text_features: bool = False,
    n_samples: int = active.BATCH_SIZE,
    **options,
) -> Screened:
    """Screening with engineered features, feature selection or an ensemble, balanced training rows and a batch strategy."""
    kind = "ensemble" if use_ensemble or strategy == "committee" else model
    pipeline = screener_pipeline(
        kind,
        select_features=select_features and kind == "random_forest",
        resampling="combined" if handle_imbalance else None,
        text_features=text_features,
        **options,
    )
    folds = cv_folds if kind == "random_forest" else 0
    return screen(articles, exclusion, inclusion, labels, pipeline, folds, strategy, n_samples)
