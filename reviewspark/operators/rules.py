"""Rule-based screening, and decisions merged from rules and a classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Decisions, their confidence under a rule, and the reason texts.
DECISIONS = ["include", "exclude", "uncertain"]
EXCLUDE_CONFIDENCE, INCLUDE_CONFIDENCE, UNCERTAIN_CONFIDENCE = 0.9, 0.7, 0.5
EXCLUDE_REASON = "Exclusion criterion met: "
INCLUDE_REASON = "Inclusion criterion met: "
UNCERTAIN_REASON = "No clear inclusion or exclusion criteria met"
ML_INCLUDE_REASON = "ML model predicts inclusion (probability: %.2f)"
ML_EXCLUDE_REASON = "ML model predicts exclusion (probability: %.2f)"


def first_criterion(body: Column, exclusion: Sequence[str], inclusion: Sequence[str]) -> Column:
    """Decision and phrase of the first criterion met: exclusion phrases in order, then inclusion phrases."""
    criteria = [("exclude", p) for p in exclusion] + [("include", p) for p in inclusion]
    return F.coalesce(
        *[
            F.when(body.contains(phrase.lower()), F.struct(F.lit(kind).alias("kind"), F.lit(phrase).alias("phrase")))
            for kind, phrase in criteria
        ],
        F.struct(F.lit("uncertain").alias("kind"), F.lit("").alias("phrase")),
    )


def rule_screen(articles: DataFrame, exclusion: Sequence[str], inclusion: Sequence[str]) -> DataFrame:
    """Add decision, reason and confidence. An exclusion phrase wins; phrases may sit inside words.

    The lower-case text and the criterion found are columns of their own, so each is worked out once per article.
    """
    body = F.concat(F.lower(tx.text("title")), F.lit(" "), F.lower(tx.text("abstract")))
    found = articles.withColumn("_body", body).withColumn(
        "_found", first_criterion(F.col("_body"), exclusion, inclusion)
    )
    kind, phrase = F.col("_found.kind"), F.col("_found.phrase")
    return found.withColumns(
        {
            "decision": kind,
            "reason": F.when(kind == "exclude", F.concat(F.lit(EXCLUDE_REASON), phrase))
            .when(kind == "include", F.concat(F.lit(INCLUDE_REASON), phrase))
            .otherwise(UNCERTAIN_REASON),
            "confidence": F.when(kind == "exclude", EXCLUDE_CONFIDENCE)
            .when(kind == "include", INCLUDE_CONFIDENCE)
            .otherwise(UNCERTAIN_CONFIDENCE),
        }
    ).drop("_body", "_found")


def decision_counts(results: DataFrame) -> DataFrame:
    """Articles per decision; a decision nobody got counts zero."""
    counted = [F.struct(F.lit(d).alias("decision"), F.count_if(F.col("decision") == d).alias("n")) for d in DECISIONS]
    return results.agg(F.array(*counted).alias("rows")).select(F.inline("rows"))


def prediction_counts(predictions: DataFrame) -> DataFrame:
    counted = [
        F.struct(F.lit(p).alias("prediction"), F.count_if(F.col("prediction") == p).alias("n")) for p in (0, 1)
    ]
    return predictions.agg(F.array(*counted).alias("rows")).select(F.inline("rows"))


def uncertain_subset(results: DataFrame) -> DataFrame:
    return results.filter(F.col("decision") == "uncertain")


def join_seed_labels(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled articles; labels of unknown articles are dropped."""
    return articles.join(labels.select("entry_id", "label"), "entry_id")


def selected_rows(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    return predictions.join(selected.select("entry_id"), "entry_id", "left_semi")


def class_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def training_guards(labelled: DataFrame) -> dict[str, int]:
    """Class sizes of a usable training set; raises when there are too few rows or one class only."""
    row = class_distribution(labelled).collect()[0].asDict()
    if row["n_samples"] < 2:
        raise ValueError("Not enough training data, need at least 2 examples")
    if not (row["positive"] and row["negative"]):
        raise ValueError("Training data must include both positive and negative examples")
    return row


def prediction_confidence(prediction: Column | str = "prediction", probability: Column | str = "probability") -> Column:
    probability = F.col(probability) if isinstance(probability, str) else probability
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(prediction == 1, probability).otherwise(1 - probability)


def ml_reason(prediction: Column, probability: Column) -> Column:
    shown = prediction_confidence(prediction, probability)
    return F.when(prediction == 1, F.format_string(ML_INCLUDE_REASON, shown)).otherwise(
        F.format_string(ML_EXCLUDE_REASON, shown)
    )


def apply_predictions(results: DataFrame, prediction: str, probability: str) -> DataFrame:
    """Let uncertain rows with a prediction take the classifier's decision; the two columns are dropped."""
    p, s = F.col(prediction), F.col(probability)
    used = results.withColumn("_use", (F.col("decision") == "uncertain") & p.isNotNull())
    return used.withColumns(
        {
            "decision": F.when(F.col("_use"), F.when(p == 1, "include").otherwise("exclude")).otherwise(
                F.col("decision")
            ),
            "reason": F.when(F.col("_use"), ml_reason(p, s)).otherwise(F.col("reason")),
            "confidence": F.when(F.col("_use"), prediction_confidence(p, s)).otherwise(F.col("confidence")),
            "ml_probability": F.when(F.col("_use"), s),
        }
    ).drop(prediction, probability, "_use")


def merge_decisions(rules: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rule results in which scored uncertain articles take the classifier's decision."""
    scores = predictions.select("entry_id", F.col("prediction").alias("_p"), F.col("probability").alias("_s"))
    return apply_predictions(rules.join(scores, "entry_id", "left"), "_p", "_s")


RESULT_FIELDS = ["title", "author", "year", "journal", "abstract"]


def result_projection(results: DataFrame) -> DataFrame:
    """The reported table: rule rows carry a reason, classifier rows a probability."""
    fields = ["entry_id"] + [tx.text(c).alias("authors" if c == "author" else c) for c in RESULT_FIELDS]
    if "decision" in results.columns:
        return results.select(*fields, "decision", "reason", "confidence")
    decision = F.when(F.col("prediction") == 1, "include").otherwise("exclude")
    return results.select(
        *fields, decision.alias("decision"), "probability", prediction_confidence().alias("confidence")
    )

