"""The corpus pipeline: documents in, token sequences out, one stage per operator."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import jaccard_join, mixing, quality_rules, sentencepiece_bpe, substring_dedup
from tidewatch.llm.registry import prepare
from tidewatch.session import materialise, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_SCRATCH: dict[str, list[str]] = {}


def _stage(function):
    """Settings for a stage, and an end to the scratch tables of the stage before, which has been written."""

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        application = spark.sparkContext.applicationId
        release(spark, _SCRATCH.pop(application, []))
        before = set(written(spark))
        out = function(spark, docs, sf_dir)
        _SCRATCH[application] = [path for path in written(spark) if path not in before]
        return out

    return staged


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality rules keep; the rules are certified on the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, labels)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates (five words, similarity 0.8) the document of the smallest id."""
    return jaccard_join.without_copies(docs)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that an earlier document has too."""
    found = materialise(substring_dedup.repeated_passages(docs))
    cut = substring_dedup.without_passages(docs, found)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that the sources reach their target weights."""
    return mixing.mixed_rows(docs).select(COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again: identifiers, their number, and whether the text comes back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), model)
    # The normaliser leaves texts alone but for its space mark, which decodes to a space.
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return coded.select("doc_id", "source", "lang", "ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources", mix),
    ("SentencePiece encoding", tokens),
]

# Compact windows and encoding can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
