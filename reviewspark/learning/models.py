"""Classifiers with balanced class weights, feature selection, ensembles and resampling as Spark ML stages.

All estimators read a ``features`` vector and a 0/1 ``label``; fitted models are built from Spark ML models and
small column-expression transformers, so they save and load with Spark ML persistence.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resample as rs
from ..session import checkpoint
from .forest import fit_forest
from .parallel import run_all

# Forest and regression settings, solver tolerance, ensemble threshold, seed.
TOLERANCE = 1e-4
SEED = 42
FOREST_TREES, SELECTION_TREES = 100, 50
INVERSE_REGULARIZATION = 1.0
THRESHOLD = 0.5

MAX_DEPTH = 30  # the deepest tree Spark grows
CALIBRATION_FOLDS = 3
SOLVER_ROWS = 16384  # rows of a task of the linear solvers, whose many short passes cost more in tasks than in sums
KINDS = ("random_forest", "logistic_regression", "svm")


def label_sizes(dataset: DataFrame) -> dict[int, int]:
    return {int(r["label"]): r["count"] for r in dataset.groupBy("label").count().collect()}


def balanced_weights(dataset: DataFrame, sizes: dict[int, int] | None = None) -> tuple[DataFrame, int]:
    """Add ``_weight`` = n / (2 * rows of the class) and return the number of rows."""
    sizes = label_sizes(dataset) if sizes is None else sizes
    n = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("Training data must include both positive and negative examples")
    weight = F.when(F.col("label") == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0]))
    return dataset.withColumn("label", F.col("label").cast("double")).withColumn("_weight", weight), n


class ScreenClassifier(Estimator, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A random forest, logistic regression or calibrated linear SVM with balanced class weights."""

    kind = Param(Params._dummy(), "kind", "which classifier", TypeConverters.toString)
    c = Param(Params._dummy(), "c", "inverse regularization strength", TypeConverters.toFloat)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth limit of the trees", TypeConverters.toInt)
    minInstances = Param(Params._dummy(), "minInstances", "least rows in a leaf", TypeConverters.toInt)
    prefix = Param(Params._dummy(), "prefix", "prefix of the output columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind="random_forest", c=INVERSE_REGULARIZATION, numTrees=FOREST_TREES,
                 maxDepth=MAX_DEPTH, minInstances=1, seed=SEED, prefix=""):
        super().__init__()
        self._setDefault(kind="random_forest", c=INVERSE_REGULARIZATION, numTrees=FOREST_TREES,
                         maxDepth=MAX_DEPTH, minInstances=1, seed=SEED, prefix="")
        self._set(**self._input_kwargs)

    def _columns(self) -> dict[str, str]:
        prefix = self.getOrDefault("prefix")
        return {
            "featuresCol": "features", "labelCol": "label", "weightCol": "_weight",
            "predictionCol": f"{prefix}prediction", "rawPredictionCol": f"{prefix}rawPrediction",
        }

    def _fit(self, dataset: DataFrame) -> Model:
        kind = self.getOrDefault("kind")
        if kind not in KINDS:
            raise ValueError(f"unknown classifier {kind!r}, expected one of {', '.join(KINDS)}")
        sizes = label_sizes(dataset)
        rows, n = balanced_weights(dataset, sizes)
        probability = f"{self.getOrDefault('prefix')}probability"
        if kind == "random_forest":
            forest = RandomForestClassifier(
                numTrees=self.getOrDefault("numTrees"), maxDepth=self.getOrDefault("maxDepth"),
                minInstancesPerNode=self.getOrDefault("minInstances"), seed=self.getSeed(),
                featureSubsetStrategy="sqrt", probabilityCol=probability, **self._columns(),
            )
            return fit_forest(forest, rows, sizes, [n / (2.0 * sizes[y]) for y in (0, 1)])
        rows = rows.coalesce(math.ceil(n / SOLVER_ROWS))
        if kind == "logistic_regression":
            return self._logistic(n, probability).fit(rows)
        return self._fit_svm(rows, n, probability)

    def _logistic(self, n: int, probability: str) -> LogisticRegression:
        return LogisticRegression(
            regParam=1.0 / (self.getOrDefault("c") * n), elasticNetParam=0.0, standardization=False,
            maxIter=100, tol=TOLERANCE, probabilityCol=probability, **self._columns(),
        )

    def _fit_svm(self, rows: DataFrame, n: int, probability: str) -> PipelineModel:
        """Margins of rows left out of the fit are turned into probabilities by a logistic curve (Platt 1999)."""
        prefix = self.getOrDefault("prefix")
        columns = {**self._columns(), "rawPredictionCol": f"{prefix}margin", "predictionCol": f"{prefix}side"}
        svc = LinearSVC(regParam=1.0 / (self.getOrDefault("c") * n), standardization=False, maxIter=100, tol=TOLERANCE, **columns)
        fold = F.pmod(F.xxhash64(F.col("features").cast("string"), F.lit(self.getSeed())), F.lit(CALIBRATION_FOLDS))
        folds = rows.withColumn("_fold", fold)
        parts = [folds.filter(F.col("_fold") != i) for i in range(CALIBRATION_FOLDS)]
        fits = [lambda part=part: svc.fit(part) for part in parts if part.select("label").distinct().count() == 2]
        model, *others = run_all([lambda: svc.fit(rows), *fits])
        if len(others) == CALIBRATION_FOLDS:
            scored = [m.transform(folds.filter(F.col("_fold") == i)) for i, m in enumerate(others)]
            held_out = reduce(DataFrame.unionByName, scored)
        else:  # too few rows to leave any out
            held_out = model.transform(rows)
        curve = LogisticRegression(
            labelCol="label", featuresCol=f"{prefix}margin", weightCol="_weight", regParam=1e-6,
            standardization=False, probabilityCol=probability, predictionCol=f"{prefix}prediction",
            rawPredictionCol=f"{prefix}rawPrediction",
        ).fit(held_out.select("label", "_weight", f"{prefix}margin"))
        return PipelineModel([model, curve])


class ImportanceSelector(Estimator, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the features whose forest importance reaches the mean importance."""

    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth limit of the trees", TypeConverters.toInt)
    inputCol = Param(Params._dummy(), "inputCol", "vector to select from", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "selected vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="all_features", outputCol="features", numTrees=SELECTION_TREES,
                 maxDepth=MAX_DEPTH, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="all_features", outputCol="features", numTrees=SELECTION_TREES,
                         maxDepth=MAX_DEPTH, seed=SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        get = self.getOrDefault
        forest = RandomForestClassifier(
            numTrees=get("numTrees"), maxDepth=get("maxDepth"), seed=get("seed"), featureSubsetStrategy="sqrt",
            featuresCol=get("inputCol"), labelCol="label",
        )
        weights = fit_forest(forest, dataset, label_sizes(dataset)).featureImportances.toArray()
        kept = [int(i) for i in (weights >= weights.mean()).nonzero()[0]]
        return VectorSlicer(inputCol=get("inputCol"), outputCol=get("outputCol"), indices=kept)


# -- ensembles -----------------------------------------------------------------------------------------


def soft_vote(probabilities: Sequence[Column]) -> Column:
    """Mean include probability of the members."""
    return sum(probabilities[1:], probabilities[0]) / len(probabilities)


def hard_vote(predictions: Sequence[Column]) -> Column:
    """Share of members that say include."""
    return soft_vote([p.cast("double") for p in predictions])


def weighted_vote(probabilities: Sequence[Column | None], weights: Sequence[float] | None = None) -> Column:
    """Weighted include probability. A member without a probability (None, or null in a row) adds nothing and
    its weight is not given to the others."""
    weights = list(weights) if weights is not None else [1.0] * len(probabilities)
    total = sum(weights)
    parts = [
        F.coalesce(p, F.lit(0.0)) * F.lit(w / total) for p, w in zip(probabilities, weights) if p is not None
    ]
    if not parts:
        raise ValueError("No estimator with a probability output")
    return sum(parts[1:], parts[0])


def vote_decision(score: Column, voting: str = "soft", threshold: float = THRESHOLD) -> Column:
    """Soft and hard voting go to include only above one half (ties to exclude); weighted from the threshold on."""
    return F.when(score >= threshold if voting == "weighted" else score > 0.5, 1).otherwise(0)


class VoteCombiner(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Combines the member columns of an ensemble into ``probability`` and ``prediction``."""

    voting = Param(Params._dummy(), "voting", "soft, hard or weighted", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "member weights", TypeConverters.toListFloat)
    threshold = Param(Params._dummy(), "threshold", "include from this probability on", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, voting="soft", weights=None, threshold=THRESHOLD):
        super().__init__()
        self._setDefault(voting="soft", threshold=THRESHOLD)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        voting, names = self.getOrDefault("voting"), self.getInputCols()
        shares = [vector_to_array(f"{p}probability")[1] for p in names]
        if voting == "hard":
            score = hard_vote([F.col(f"{p}prediction") for p in names])
        elif voting == "weighted":
            score = weighted_vote(shares, self.getOrDefault("weights") if self.isSet("weights") else None)
        else:
            score = soft_vote(shares)
        decision = vote_decision(F.col("_score"), voting, self.getOrDefault("threshold"))
        return (
            dataset.withColumn("_score", score)
            .withColumn("probability", array_to_vector(F.array(1.0 - F.col("_score"), F.col("_score"))))
            .withColumn("prediction", decision.cast("double"))
            .drop("_score")
        )


class _NestedWriter(MLWriter):
    """Saves the params of an estimator, and each estimator inside it in a folder of its own."""

    def __init__(self, instance: Estimator, inner: dict[str, Estimator]):
        super().__init__()
        self.instance, self.inner = instance, inner

    def saveImpl(self, path: str) -> None:
        own = {p.name: v for p, v in self.instance.extractParamMap().items() if p.name not in NESTED}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"inner": list(self.inner), "own": own}, {})
        for name, estimator in self.inner.items():
            estimator.write().overwrite().save(f"{path}/inner/{name}")


class _NestedReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        inner = [(n, DefaultParamsReader.loadParamsInstance(f"{path}/inner/{n}", self.sparkSession)) for n in metadata["inner"]]
        instance = self.cls.holding(inner)
        instance._resetUid(metadata["uid"])
        instance._set(**metadata["own"])
        return instance


class _Holder(Estimator, MLWritable, MLReadable):
    """An estimator with others inside: copies and parameter grids reach those, and all are saved and loaded together."""

    def inner(self) -> dict[str, Estimator]:
        raise NotImplementedError

    @classmethod
    def holding(cls, inner: list[tuple[str, Estimator]]):
        raise NotImplementedError

    def _with_inner(self, inner: dict[str, Estimator]) -> None:
        raise NotImplementedError

    def copy(self, extra=None):
        that = super().copy(extra)
        that._with_inner({name: estimator.copy(extra) for name, estimator in self.inner().items()})
        return that

    def write(self) -> MLWriter:
        return _NestedWriter(self, self.inner())

    @classmethod
    def read(cls) -> MLReader:
        return _NestedReader(cls)


NESTED = ("members", "estimator")


class Ensemble(_Holder):
    """Fits every member on the same rows and combines them by soft, hard or weighted voting."""

    members = Param(Params._dummy(), "members", "names and classifiers")
    voting = Param(Params._dummy(), "voting", "soft, hard or weighted", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "member weights", TypeConverters.toListFloat)
    threshold = Param(Params._dummy(), "threshold", "include from this probability on", TypeConverters.toFloat)

    def __init__(self, members: Sequence[tuple[str, ScreenClassifier]] | None = None, voting: str = "soft",
                 weights: Sequence[float] | None = None, threshold: float = THRESHOLD):
        super().__init__()
        if voting not in ("soft", "hard", "weighted"):
            raise ValueError(f"unknown voting {voting!r}")
        kinds = [("rf", "random_forest"), ("lr", "logistic_regression")]
        if voting != "weighted":
            kinds.append(("svm", "svm"))
        self._set(members=list(members or [(name, ScreenClassifier(kind=kind)) for name, kind in kinds]), voting=voting, threshold=threshold)
        if weights is not None:
            self._set(weights=[float(w) for w in weights])

    def inner(self) -> dict[str, Estimator]:
        return dict(self.getOrDefault("members"))

    @classmethod
    def holding(cls, inner: list[tuple[str, Estimator]]) -> Ensemble:
        return cls(inner)

    def _with_inner(self, inner: dict[str, Estimator]) -> None:
        self._set(members=list(inner.items()))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        members = self.getOrDefault("members")
        prefixes = [f"{name}_" for name, _ in members]
        named = [m.copy({m.prefix: p}) for p, (_, m) in zip(prefixes, members)]
        fitted = run_all([lambda m=m: m.fit(dataset) for m in named])
        combiner = VoteCombiner(
            inputCols=prefixes, voting=self.getOrDefault("voting"), threshold=self.getOrDefault("threshold"),
            weights=self.getOrDefault("weights") if self.isSet("weights") else None,
        )
        return PipelineModel([*fitted, combiner])


def member_votes(columns: Sequence[str]) -> Column:
    """The predictions of all members of an ensemble, from the columns that its model adds."""
    names = sorted(c for c in columns if c.endswith("_prediction"))
    if not names:
        raise ValueError("the model has no members that vote")
    return F.array(*[F.col(c).cast("double") for c in names])


class ResampledEstimator(_Holder):
    """Balances the training rows, writes them down once, then fits ``estimator`` on them; scoring sees plain rows.

    Rows too few for resampling are fitted as they are, with a warning.
    """

    estimator = Param(Params._dummy(), "estimator", "what is fitted on the balanced rows")
    strategy = Param(Params._dummy(), "strategy", "over, under or combined", TypeConverters.toString)
    overRatio = Param(Params._dummy(), "overRatio", "minority rows over majority rows", TypeConverters.toFloat)
    underRatio = Param(Params._dummy(), "underRatio", "minority rows over majority rows kept", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the random choices", TypeConverters.toInt)
    entryId = Param(Params._dummy(), "entryId", "column that names a row", TypeConverters.toString)

    def __init__(self, estimator: Estimator, strategy: str = "combined",
                 oversampling_ratio: float = rs.OVERSAMPLING_RATIO,
                 undersampling_ratio: float = rs.UNDERSAMPLING_RATIO, seed: int = SEED, entry_id: str = "entry_id"):
        super().__init__()
        self._set(estimator=estimator, strategy=strategy, overRatio=oversampling_ratio, underRatio=undersampling_ratio, seed=seed, entryId=entry_id)

    def inner(self) -> dict[str, Estimator]:
        return {"estimator": self.getOrDefault("estimator")}

    @classmethod
    def holding(cls, inner: list[tuple[str, Estimator]]) -> ResampledEstimator:
        return cls(inner[0][1])

    def _with_inner(self, inner: dict[str, Estimator]) -> None:
        self._set(estimator=inner["estimator"])

    def _fit(self, dataset: DataFrame) -> Model:
        get = self.getOrDefault
        # written down once: ranks, neighbours and the union below each read them
        rows = checkpoint(dataset.select(F.col(get("entryId")).alias("id"), F.col("label").cast("int").alias("label"), "features"))
        try:
            balanced = checkpoint(rs.resample(rows, get("strategy"), get("overRatio"), get("underRatio"), get("seed")))
        except ValueError as error:
            warnings.warn(f"the rows are fitted as they are: {error}", stacklevel=2)
            balanced = rows
        return get("estimator").fit(balanced)
