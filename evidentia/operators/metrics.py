"""Retrieval metrics over ranked hits (qid, path, rank) and judgements (qid, path, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evaluation(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """qid, precision, recall, mrr, ndcg at k for every judged query. Nothing relevant: recall 1, others 0."""
    gain: Column = F.pow(F.lit(2.0), F.col("grade")) - 1
    both = judged.filter("grade > 0").join(F.broadcast(hits.filter(F.col("rank") <= k).select("qid", "path", "rank")), ["qid", "path"], "left")
    # a row for each grade of a query: the ideal order has its pages one after the other, so their number is all it takes
    grades = both.groupBy("qid", "grade").agg(
        F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank").isNotNull(), gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    upto = F.sum("n").over(W.partitionBy("qid").orderBy(F.desc("grade")).rowsBetween(W.unboundedPreceding, 0))
    places = F.sequence(F.lit(1), F.lit(max(k, 1)))
    ideal = F.aggregate(F.filter(places, lambda i: (i <= k) & (i > F.col("upto") - F.col("n")) & (i <= F.col("upto"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = grades.withColumn("upto", upto).withColumn("best", gain * ideal).groupBy("qid").agg(
        F.sum("n").alias("relevant"), F.sum("found").alias("found"), F.min("first").alias("first"), F.sum("dcg").alias("dcg"), F.sum("best").alias("best")
    )
    shown = hits.filter(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("shown"))
    every = judged.select("qid").distinct().join(per, "qid", "left").join(shown, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "qid",
        F.round(zero(F.col("found") / F.col("shown")), 6).alias("precision"),
        F.round(F.coalesce(F.col("found") / F.col("relevant"), F.lit(1.0)), 6).alias("recall"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
        F.round(zero(F.when(F.col("best") > 0, F.col("dcg") / F.col("best"))), 6).alias("ndcg"),
    )
