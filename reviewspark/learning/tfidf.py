"""TF-IDF features of cleaned article text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

# Vocabulary limits.
MAX_FEATURES, MIN_DF, MAX_DF = 5000, 2, 0.85

COUNTED_ROWS, WEIGHED_ROWS = 4096, 2048  # texts of a slice: about 20 bytes a word are held several times over
PAIRED_WORDS = 100_000  # with more frequent words than this all pairs are counted

# Default English stop words (function words); pass another list where yours differs.
ENGLISH_STOP_WORDS = """
a about above across after again against all almost alone along already also although always am among an and
another any anyone anything anywhere are around as at be became because become becomes been before being below
between both but by can cannot could did do does doing down during each either else enough even ever every
everyone everything everywhere few for from further had has have having he hence her here hers herself him himself
his how however i if in indeed into is it its itself just least less many may me might more most much must my
myself neither never nevertheless no nobody none nor not nothing now of off often on once only onto or other others
our ours ourselves out over own per perhaps rather same she should since so some somehow something sometimes still
such than that the their theirs them themselves then there therefore these they this those though through thus to
together too toward under until up upon us very was we well were what whatever when where whether which while who
whom whose why will with within without would yet you your yours yourself
""".split()


def _times(codes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in order, texts with each, occurrences of each), from the codes that stand in ``n`` texts."""
    met = np.sort(codes * n + docs)
    fresh = np.diff(met, prepend=-1) != 0
    codes = met // max(1, n)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    seen = np.append(0, np.cumsum(fresh))
    ends = np.append(first, len(met))
    return codes[first], np.diff(seen[ends]), np.diff(ends)


def _slices(arrays: Iterator[pa.Array], rows: int) -> Iterator[pa.Array]:
    for array in arrays:
        for low in range(0, len(array), rows):
            yield array[low : low + rows]
    pa.default_memory_pool().release_unused()  # the worker may wait beside others that need it


def _coded(texts: pa.Array, stops: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch, and the code and the text of each occurrence.

    Words of a cleaned text have two characters or more and are no stop words; lists of words are taken as they are.
    """
    listed = pa.types.is_list(texts.type)
    lists = texts if listed else pc.split_pattern(texts.cast(pa.string()), " ")
    words = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    names, codes, docs = words.dictionary, words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    if listed:
        return names, codes, docs
    kept = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, value_set=stops)))
    fits = kept.to_numpy(zero_copy_only=False).astype(bool)
    own = fits[codes]
    return names.filter(kept), (np.cumsum(fits) - 1)[codes[own]], docs[own]


def _counted(terms: pa.Array, d: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(d, pa.int64()), pa.array(f, pa.int64())], ["term", "d", "f"])


def _words(batches: Iterator[pa.RecordBatch], stops: pa.Array) -> Iterator[pa.RecordBatch]:
    """(term, d: texts with it, f: occurrences), each word once per batch."""
    for texts in _slices((batch.column(0) for batch in batches), COUNTED_ROWS):
        names, word, doc = _coded(texts, stops)
        codes, d, f = _times(word, doc, len(texts))
        yield _counted(names.take(pa.array(codes)), d, f)


def _pairs(batches: Iterator[pa.RecordBatch], of: pa.Array | None, stops: pa.Array | None = None, numbered: bool = False) -> Iterator[pa.RecordBatch]:
    """The same for pairs of neighbouring words; with ``of`` only pairs of those, as one number each if ``numbered``."""
    for texts in _slices((batch.column(0) for batch in batches), COUNTED_ROWS):
        names, word, doc = _coded(texts, stops)
        met = doc[1:] == doc[:-1]
        if of is not None:
            word, names = _places(names, of)[word], of
            met &= (word[1:] >= 0) & (word[:-1] >= 0)
        codes, d, f = _times((word[:-1] * len(names) + word[1:])[met], doc[1:][met], len(texts))
        yield _counted(pa.array(codes) if numbered else _joined(names, codes), d, f)


def _joined(names: pa.Array, pairs: np.ndarray) -> pa.Array:
    first, second = np.divmod(pairs, max(1, len(names)))
    return pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ").cast(pa.string())


def _places(names: pa.Array, of: pa.Array) -> np.ndarray:
    """Where each name stands in ``of``, -1 for none."""
    return pc.index_in(names, value_set=of).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def tfidf_vocab(
    docs: DataFrame,
    clean: str = "clean",
    n: int | None = None,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS),
    bigrams: bool = True,
) -> DataFrame:
    """At most ``max_features`` terms with document frequency, corpus frequency and inverse document frequency.

    Words are counted first. A pair occurs no oftener than either of its words, so where ``max_features`` words are left only
    pairs of words that reach the last one's frequency are counted. Both counts of a term come from one aggregation over
    what each batch of texts has counted; ties at the cut go to the smaller term.
    """
    n = docs.count() if n is None else n
    texts, stops = docs.select(F.col(clean).cast("string")), pa.array(list(stop_words), pa.string())

    def counted(count: Callable, kind: str) -> DataFrame:
        counts = texts.mapInArrow(count, f"term {kind}, d long, f long").groupBy("term").agg(F.sum("d").alias("df"), F.sum("f").alias("tf"))
        return counts.withColumn("fits", (F.col("df") >= min_df) & (F.col("df") <= max_df * n))

    counts, of = counted(lambda batches: _words(batches, stops), "string"), None
    if bigrams:
        counts = checkpoint(counts)
        least = counts.filter("fits").orderBy(F.desc("tf")).limit(max_features).agg(F.count("tf"), F.min("tf")).first()
        if least[0] == max_features:
            often = counts.filter(F.col("tf") >= least[1]).select("term").limit(PAIRED_WORDS + 1).toArrow()["term"].combine_chunks()
            of = often.cast(pa.string()).sort() if len(often) <= PAIRED_WORDS else None
        pairs = counted(lambda batches: _pairs(batches, of, stops, of is not None), "string" if of is None else "long")
        if of is not None:  # pairs below the last kept word are not among the first

            def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([_joined(of, batch.column(0).to_numpy()), *batch.columns[1:]], batch.schema.names)

            pairs = pairs.filter(F.col("tf") >= least[1]).mapInArrow(named, counts.schema)
        counts = counts.unionByName(pairs)
    kept = counts.filter("fits").drop("fits")
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0
    return kept.orderBy(F.desc("tf"), "term").limit(max_features).withColumn("idf", idf)


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


class TermWeights(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weights of the vocabulary's terms in a cleaned text, as a sparse vector of length 1."""

    vocabulary = Param(Params._dummy(), "vocabulary", "words and word pairs", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight of one occurrence of each", TypeConverters.toListFloat)
    stopWords = Param(Params._dummy(), "stopWords", "words left out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vocabulary=None, idf=None, stopWords=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms, idf = self.getOrDefault("vocabulary"), np.array(self.getOrDefault("idf"))
        stops = pa.array(self.getOrDefault("stopWords"), pa.string())
        parts = [t.split(" ") for t in terms]
        of = pa.array(sorted({w for p in parts for w in p}), pa.string())
        code = {w: i for i, w in enumerate(of.to_pylist())}
        single, pairs = np.full(len(of), -1), []
        for at, p in enumerate(parts):
            if len(p) == 1:
                single[code[p[0]]] = at
            else:
                pairs.append((code[p[0]] * len(of) + code[p[1]], at))
        pairs = np.array(sorted(pairs) + [(np.iinfo(np.int64).max, -1)])

        def weighed(batch: pa.Array) -> Iterator[pa.Array]:
            for texts in _slices([batch], WEIGHED_ROWS):
                names, word, doc = _coded(texts, stops)
                word = _places(names, of)[word]
                follows = (doc[1:] == doc[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
                both = (word[:-1] * len(of) + word[1:])[follows]
                at = np.searchsorted(pairs[:, 0], both)
                at = np.where(pairs[at, 0] == both, pairs[at, 1], -1)
                at = np.concatenate([np.where(word < 0, -1, single[word]), at])
                met = np.sort((np.concatenate([doc, doc[1:][follows]]) * len(terms) + at)[at >= 0])
                first = np.flatnonzero(np.diff(met, prepend=-1))
                doc, term = np.divmod(met[first], len(terms))
                values = np.diff(np.append(first, len(met))) * idf[term]
                values /= np.sqrt(np.bincount(doc, values * values, len(texts)))[doc]
                ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (values, pa.float64()))]
                same = [pa.array(np.full(len(texts), x), kind) for x, kind in ((0, pa.int8()), (len(terms), pa.int32()))]
                yield pa.StructArray.from_arrays([*same, *lists], fields=list(_SPARSE))

        def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.concat_arrays([pa.array([], _SPARSE), *weighed(batch)])

        vector = F.arrow_udf(weights, VectorUDT())
        return dataset.withColumn(self.getOutputCol(), vector(F.col(self.getInputCol()).cast("string")))


class TfidfVectorizer(
    Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Learns the vocabulary of a cleaned text column; the fitted model works through batches of texts, without a shuffle.

    Weights are tf * (ln((1 + n) / (1 + df)) + 1), each article scaled to length 1.
    """

    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size limit", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least documents with the term", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of documents with the term", TypeConverters.toFloat)
    bigrams = Param(Params._dummy(), "bigrams", "add word pairs", TypeConverters.toBoolean)
    stopWords = Param(Params._dummy(), "stopWords", "words left out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="clean", outputCol="features", maxFeatures=MAX_FEATURES, minDF=MIN_DF,
                 maxDF=MAX_DF, bigrams=True, stopWords=None):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(inputCol="clean", outputCol="features", maxFeatures=MAX_FEATURES, minDF=MIN_DF,
                         maxDF=MAX_DF, bigrams=True, stopWords=ENGLISH_STOP_WORDS)
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> TermWeights:
        get = self.getOrDefault
        stops, pairs = get("stopWords"), get("bigrams")
        vocab = tfidf_vocab(
            dataset, get("inputCol"), None, get("maxFeatures"), get("minDF"), get("maxDF"), stops, pairs
        )
        chosen = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())
        if not chosen:
            raise ValueError("no term is left in the vocabulary")
        return TermWeights(
            inputCol=get("inputCol"), outputCol=get("outputCol"), vocabulary=[t for t, _ in chosen], idf=[w for _, w in chosen], stopWords=list(stops),
        )


def vocabulary(model: TermWeights | PipelineModel) -> list[str]:
    """Feature names of a fitted vectorizer, or of a pipeline that has one."""
    if isinstance(model, TermWeights):
        return list(model.getOrDefault("vocabulary"))
    for stage in model.stages:
        if isinstance(stage, (TermWeights, PipelineModel)):
            return vocabulary(stage)
    return []


def vector_rows(df: DataFrame, terms: Sequence[str], entry_id: str = "entry_id", col: str = "features") -> DataFrame:
    """The non-zero entries of a term vector as (entry_id, term, weight) rows."""
    names = F.split(F.lit("\n".join(terms)), "\n")
    parts = F.unwrap_udt(F.col(col))
    # sparse vectors hold their places; dense ones have a value in every place
    places = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return (
        df.select(entry_id, F.inline(F.arrays_zip(places.alias("i"), parts["values"].alias("weight"))).alias("i", "weight"))
        .filter(F.col("weight") != 0)
        .select(entry_id, F.get(names, F.col("i")).alias("term"), "weight")
    )
