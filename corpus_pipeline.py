"""Corpus preparation as five stages over `documents`, each written as Parquet and read again for the next.

Every stage works on all rows its predecessor kept, and its decisions take effect. All but the last return the columns of
documents; the last one returns what the encoder gives per row (a document that the mix repeats has a row per copy).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm import bpe, minhash, mixing, quality, suffix_dedup
from reviewspark.llm.common import packed, saved, unpacked

REPEAT_BYTES = 200
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
TOKENIZER = "byte_bpe_50k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.

    Null and empty texts have no features and get the model's offset as score; rows without id are scored like others and
    teach nothing; equal texts have equal scores, so repeated rows stay or go together; an empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score_documents(packed(docs), model, ["row", "text"])
    return unpacked(scored.where("score >= 0.3"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    Groups are made of rows, so repeated ids and rows without id are grouped by their texts like all others. The row with
    the smallest id stays, one without id only where no other is. Rows without words (null and empty texts among them) are
    no one's duplicates and stay; an empty table gives an empty table.
    """
    rows = saved(packed(docs, F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").alias("id")), "pipeline-rows")
    groups = minhash.near_duplicates(rows, width=5, threshold=0.8, id_col="row_no").select("row_no", "component_id")
    order = F.struct(F.col("id").isNull(), "id", F.xxhash64("text"), "row_no")
    named = rows.select("row_no", order.alias("order")).join(groups, "row_no")
    kept = named.groupBy("component_id").agg(F.min("order")["row_no"].alias("row_no")).select("row_no")
    return unpacked(rows.join(kept, "row_no", "left_semi"), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a `REPEAT_BYTES`-byte string that also starts elsewhere is removed; n_chars follows the text.

    Passages of over 50 words are 285 bytes and more in the test data; a string of 200 bytes is some 35 words, far
    beyond a sentence that documents share by chance. Null texts become empty; repeated rows and equal texts are documents
    of their own, so of them nothing is left; an empty table gives an empty table.
    """
    rows = packed(docs, F.col("doc_id").alias("id"))
    kept = suffix_dedup.remove_repeats(rows, REPEAT_BYTES, id_col="id", keep_text=True)
    return unpacked(kept, docs.columns, text=F.col("kept_text"), n_chars=F.char_length("kept_text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights: rows are dropped or repeated as their copies say.

    Null and empty texts have no words and go; a null source is a source of its own, last; repeated rows and rows without id
    are taken by row; an empty table gives an empty table.
    """
    return mixing.apply_mix(docs, weights=WEIGHTS, share=SHARE, cap=CAP)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix, repeated rows each; a null text counts as empty; ids may be null."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # the classifier cannot be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs, "pipeline-stage")
    return docs
