"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of ``documents``; each result is written as Parquet below
``spark.checkpoint.dir`` and read again. ``ORACLE_SQL`` is None: two stages are trained
models and one is a tokenizer, which SQL can't express (see tests/llm/test_pipeline.py).
"""

from __future__ import annotations

import os
import sys
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patchtrace.llm import exact_dedup, language_id, ngram_join, packing, quality_classifier  # noqa: E402
from patchtrace.llm.common import bounded_batches, fold, table  # noqa: E402
from patchtrace.session import shared_path  # noqa: E402

#: A document stays if its quality score reaches this.
LEAST_QUALITY = 0.3
#: A document stays if its language has this posterior probability.
LEAST_LANGUAGE = 0.5

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier scores below the threshold."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"),
                                   learn_from=lambda c: fold(c, 5) != 0)
    return quality_classifier.keep_good(docs, model, threshold=LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clear language; the label column is learned from, not changed."""
    bounded_batches(spark)
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"),
                            learn_from=lambda c: fold(c, 4) != 2)
    return language_id.keep_identified(docs, model, least=LEAST_LANGUAGE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts."""
    bounded_batches(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group linked by shingle similarity."""
    bounded_batches(spark)
    return ngram_join.keep_smallest(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_classifier", quality), ("language_id", language), ("exact_dedup", exact),
          ("ngram_join", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    base = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
