"""The corpus pipeline: language ID, exact and near deduplication, removal of repeated
spans, and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``; the last returns the pieces of sequences. An
empty table passes through every stage; what a stage does with nulls and empty texts is
told by its operator.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact_dedup, language_id, near_dedup, packing, repeated_spans
from lattica.llm.common import prepare


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter go."""
    prepare(spark)
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 200-byte repeats cover."""
    prepare(spark)
    return repeated_spans.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("repeated_spans", spans),
    ("packing", packed),
]

#: SQL cannot express these stages (a learnt model, similarity classes); tests/llm holds
#: each operator against brute force, and the pipeline against its operators.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared checkpoint
    folder and read again, and goes when the next one's stands."""
    prepare(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                _delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
