"""The model's tables, built from the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page: path, title, type, tags, sources, request_id, body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("type"),
        F.array("lang", "source").alias("tags"),
        F.array("source").alias("sources"),
        F.concat(F.lit("REQ-"), (F.col("doc_id") % 50).cast("string")).alias("request_id"),
        F.coalesce("text", F.lit("")).alias("body"),
    )


def passages(pages_: DataFrame) -> DataFrame:
    """Non-empty lines of a page as its passages: path, pos, passage_id, text."""
    lines = pages_.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    return lines.withColumn("passage_id", T.passage_id(F.lit(""), F.col("text")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark passage: all its distinct tokens."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), T.distinct_tokens(F.col("text")).alias("terms"))


#: The same tables for SQL.
PAGES_SQL = """pages_m AS (SELECT 'doc/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, 'Document ' || doc_id AS title, lang AS type, [lang, source] AS tags,
  [source] AS sources, 'REQ-' || (doc_id % 50) AS request_id, coalesce(text, '') AS body, doc_id FROM documents)"""


def tokens_sql(x: str) -> str:
    """DuckDB list of all tokens of a text, with parts and repeats."""
    whole = rf"regexp_extract_all(lower({x}), '/?[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_./:#-]*')"
    return f"flatten(list_transform({whole}, lambda t: list_concat([t], list_filter(regexp_split_to_array(t, '[_./:#-]+'), lambda p: length(p) >= 2 AND p <> t))))"


#: First-seen order of distinct list items, which list_distinct doesn't keep.
def stable_sql(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


QUERIES_SQL = f"queries_m AS (SELECT item_id AS qid, {stable_sql('tk')} AS terms FROM (SELECT item_id, {tokens_sql('text')} AS tk FROM benchmark))"
