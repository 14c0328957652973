"""A corpus pipeline: raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import materialise
from driftwell.llm.exact_dedup import keep_first
from driftwell.llm.jaccard_join import keep_one_of_each
from driftwell.llm.language_id import UNKNOWN, identify, learn
from driftwell.llm.packing import pack
from driftwell.llm.pii import masked

#: A document whose best language has a lower score than this is in none of them; a half is what no bit knows anything of.
LEAST_LANGUAGE_SCORE = 0.45


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or near no language, go."""
    found = identify(docs, learn(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return found.select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return keep_first(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data of every score is replaced by its kind; n_chars follows."""
    return masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("packing", packing),
]

#: Language identification is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
