"""Numeric features of article text and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Terms counted by default, and study types with their codes in order of preference.
MEDICAL_TERMS = [
    "disease", "treatment", "patient", "study", "clinical",
    "trial", "randomized", "cohort", "meta-analysis", "review",
]
STUDY_TYPES = {
    "RCT": 1, "Meta-analysis": 2, "Review": 3, "Cohort": 4, "Case-control": 5, "Cross-sectional": 6,
}


def text_features(
    articles: DataFrame,
    terms: Sequence[str] = tuple(MEDICAL_TERMS),
    study_types: Mapping[str, int] = STUDY_TYPES,
    metadata: bool = True,
) -> DataFrame:
    """entry_id, text, title, abstract, lengths, one ``<term>_freq`` per term, year and study type code."""
    body = articles.withColumn("text", F.concat_ws(" ", *[tx.text(c) for c in ("title", "abstract", "keywords")]))
    lowered = F.lower(tx.text("keywords"))
    code = F.coalesce(
        *[F.when(lowered.contains(name.lower()), F.lit(code)) for name, code in study_types.items()],
        F.lit(None).cast("int"),
    )
    lengths = {"title_length": "title", "abstract_length": "abstract", "text_length": "text"} if metadata else {}
    return body.select(
        "entry_id",
        "text",
        tx.text("title").alias("title"),
        tx.text("abstract").alias("abstract"),
        *[F.length(tx.text(c)).alias(name) for name, c in lengths.items()],
        *[tx.count_whole_word("text", t).alias(f"{t}_freq") for t in terms],
        F.expr("try_cast(year AS int)").alias("year"),
        code.alias("study_type"),
    )


def text_and_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The text column and the numeric columns, each with the entry id."""
    return features.select("entry_id", "text"), features.drop("text", "title", "abstract")


class TextFeatureExtractor(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector of text length (optional) and whole-word counts of ``terms``."""

    terms = Param(Params._dummy(), "terms", "terms to count", TypeConverters.toListString)
    includeLength = Param(Params._dummy(), "includeLength", "start with the text length", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="text", outputCol="text_features", terms=None, includeLength=True):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(inputCol="text", outputCol="text_features", terms=MEDICAL_TERMS, includeLength=True)
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = self.getInputCol()
        values = [tx.count_whole_word(source, t) for t in self.getOrDefault("terms")]
        if self.getOrDefault("includeLength"):
            values.insert(0, F.length(tx.text(source)))
        vector = array_to_vector(F.array(*[v.cast("double") for v in values]))
        return dataset.withColumn(self.getOutputCol(), vector)
