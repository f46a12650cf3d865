"""Choice of the articles to label next. Every selector returns at most ``n`` rows, a fixed batch size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .ranking import shuffle_hash

BATCH_SIZE = 10
OVERSAMPLE = 3  # the combined strategy looks at three times the batch
CENTRES_KEPT = 16  # centres whose distances are worked out again before the nearest one is written down


def uncertainty(probability: Column | str = "probability") -> Column:
    """1 at probability 0.5, falling to 0 at 0 and 1."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return 1.0 - F.abs(p - 0.5) * 2


def select_uncertainty(predictions: DataFrame, n: int = BATCH_SIZE) -> DataFrame:
    scored = predictions.withColumn("uncertainty", uncertainty())
    return scored.orderBy(F.desc("uncertainty"), "ord").limit(n)


def select_random(predictions: DataFrame, n: int = BATCH_SIZE, seed: int = 42) -> DataFrame:
    """Seeded random choice: the diversity strategy without vectors."""
    return predictions.orderBy(shuffle_hash("entry_id", seed), "entry_id").limit(n)


def _cosine_distance(vector: Column, centre: Sequence[float]) -> Column:
    """Distance of ``vector`` to a fixed point, which goes into the plan as one constant array."""
    point = F.split(F.lit(",".join(repr(float(x)) for x in centre)), ",").cast("array<double>")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, point, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in centre) ** 0.5
    return F.when((norm == 0) | F.lit(length == 0), 1.0).otherwise(1.0 - dot / (norm * length))


def select_k_center(
    predictions: DataFrame, n: int = BATCH_SIZE, vector: str = "embedding", seed: int = 42
) -> DataFrame:
    """Greedy k-centre: start at a seeded random row, then always take the row farthest from all chosen ones.

    Each of the ``n`` rounds is one scan of (id, vector, distance to the nearest centre) that keeps a single row. The
    distance is written down every `CENTRES_KEPT` rounds, so the work grows with n and no plan holds more than those
    centres. The driver sees ids and vectors of the batch.
    """
    state = predictions.select("entry_id", F.col(vector).alias("_v"), F.lit(float("inf")).alias("_near"))
    state = checkpoint(state.filter(F.col("entry_id").isNotNull()))
    chosen: list[str] = []
    order = [shuffle_hash("entry_id", seed), F.col("entry_id")]
    while len(chosen) < n:
        found = state.orderBy(*order).limit(1).collect()
        if not found:
            break
        chosen.append(found[0]["entry_id"])
        nearer = F.least("_near", _cosine_distance(F.col("_v"), found[0]["_v"]))
        state = state.filter(F.col("entry_id") != chosen[-1]).withColumn("_near", nearer)
        if len(chosen) % CENTRES_KEPT == 0:
            state = checkpoint(state)
        order = [F.desc("_near"), F.col("entry_id")]
    batch = predictions.sparkSession.createDataFrame([(e,) for e in chosen], "entry_id string")
    return predictions.join(F.broadcast(batch), "entry_id", "left_semi")  # n ids


def select_diversity(
    predictions: DataFrame, n: int = BATCH_SIZE, vector: str | None = None, seed: int = 42
) -> DataFrame:
    if vector is None:
        return select_random(predictions, n, seed)
    return select_k_center(predictions, n, vector, seed)


def select_combined(
    predictions: DataFrame, n: int = BATCH_SIZE, vector: str | None = None, seed: int = 42
) -> DataFrame:
    """A diverse batch out of the most uncertain articles."""
    return select_diversity(select_uncertainty(predictions, OVERSAMPLE * n), n, vector, seed)


def committee_join(members: Sequence[DataFrame]) -> DataFrame:
    """Votes of all members per article; members without a vote are left out."""
    votes = [m.select("entry_id", "ord", F.col("prediction").cast("double").alias("vote")) for m in members]
    return (
        reduce(DataFrame.unionByName, votes)
        .groupBy("entry_id")
        .agg(
            F.min("ord").alias("ord"),
            F.count("vote").alias("votes"),
            F.sum("vote").alias("includes"),
            F.var_pop("vote").alias("disagreement"),
        )
        .filter(F.col("votes") > 0)
    )


def select_committee(members: Sequence[DataFrame], n: int = BATCH_SIZE) -> DataFrame:
    """The articles the members disagree on most (population variance of the votes)."""
    return committee_join(members).orderBy(F.desc("disagreement"), "ord").limit(n)


def select_disagreement(scored: DataFrame, n: int = BATCH_SIZE, votes: str = "votes") -> DataFrame:
    """Like `select_committee` for rows that hold the votes of all members in one array, null where one has no vote."""
    given = F.filter(votes, lambda v: v.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda s, v: s + v)
    mean = total / F.size(given)
    spread = F.aggregate(given, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(given)
    some = scored.filter(F.size(given) > 0).withColumn("disagreement", spread)
    return some.orderBy(F.desc("disagreement"), "ord").limit(n)


def select_model_change(
    predictions: DataFrame, n: int = BATCH_SIZE, features_norm: str | None = None
) -> DataFrame:
    """Articles expected to change the model most: uncertainty as a stand-in, or the logistic gradient length."""
    p = F.col("probability")
    change = uncertainty() if features_norm is None else p * (1 - p) * F.col(features_norm)
    return predictions.withColumn("expected_change", change).orderBy(F.desc("expected_change"), "ord").limit(n)
