"""The training-data pipeline: quality rules, near-dedup, surrogates, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but
the last return the columns of documents; each result is written as Parquet in the shared folder and
read again as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import mixing, neardup, packing, pii, quality
from evidentia.llm.common import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines and notices of the others go."""
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (five words, similarity of 80 % or more)."""
    return neardup.deduplicated(docs, shingle=5, percent=80).select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates of the same length and shape."""
    return pii.pseudonymized(docs, key=pii.surrogate_key(spark)).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens; every copy of a document is packed for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("surrogates", surrogates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokenizer of the last stage; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = ws.saved(stage(spark, docs, sf_dir), "documents", over=True)
    return STAGES[-1][1](spark, docs, sf_dir)
