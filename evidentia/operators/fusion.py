"""Fusion of ranked lists, budgets, coverage and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def reciprocal(rank: Column, weight: float = 1.0, k: int = vocab.FUSION_K) -> Column:
    return F.coalesce(weight / (k + rank), F.lit(0.0))


def _ranked(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(score), "path")))


def rrf(lists: list[tuple[DataFrame, float]], k: int = vocab.FUSION_K) -> DataFrame:
    """qid, path, score, rank: weighted reciprocal-rank fusion of (qid, path, rank) lists."""
    parts = [d.select("qid", "path", reciprocal(F.col("rank"), w, k).alias("s")) for d, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("qid", "path").agg(F.round(F.sum("s"), 9).alias("score"))
    return _ranked(fused, "score")


def merged(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """qid, path, score, rank from (qid, path, score, rank) lists: each score by its list's best, plus a reciprocal rank."""
    best = F.max("score").over(W.partitionBy("qid"))
    parts = [d.select("qid", "path", (F.coalesce(F.col("score") / F.when(best > 0, best), F.lit(0.0)) + 1 / (vocab.FUSION_K + F.col("rank"))).alias("s")) for d in lists]
    out = _ranked(reduce(DataFrame.unionByName, parts).groupBy("qid", "path").agg(F.round(F.sum("s"), 9).alias("score")), "score")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, graph: DataFrame) -> DataFrame:
    """qid, path, score, rank of three lists; a lexical page counts by its confidence (score by the query's best)."""
    conf = F.col("score") / F.max("score").over(W.partitionBy("qid"))
    lex = lexical.select("qid", "path", F.col("rank").alias("r_lex"), conf.alias("conf"))
    sem = semantic.select("qid", "path", F.col("rank").alias("r_sem"))
    gra = graph.select("qid", "path", F.col("rank").alias("r_graph"))
    all_ = lex.join(sem, ["qid", "path"], "full").join(gra, ["qid", "path"], "full")
    own = F.coalesce(F.col("conf"), F.lit(0.0))
    score = reciprocal(F.col("r_lex")) * (0.2 + 0.8 * own) + reciprocal(F.col("r_sem"), vocab.SEMANTIC_WEIGHT) + reciprocal(F.col("r_graph"), vocab.GRAPH_WEIGHT) * F.when(F.col("r_lex").isNotNull(), 0.25 + 0.75 * own).otherwise(1.0)
    return _ranked(all_.select("qid", "path", F.round(score, 9).alias("score")), "score")


def within_budget(hits: DataFrame, tokens: str, budget: int) -> DataFrame:
    """Hits up to the first that takes the running sum of `tokens` over the budget; the first always stays."""
    order = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    h = hits.withColumn("used", F.sum(tokens).over(order))
    over = F.max(F.when((F.col("used") > budget) & (F.col("rank") > 1), 1).otherwise(0)).over(order)
    return h.withColumn("_over", over).filter("_over = 0").drop("_over")


def facet_coverage(queries: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, facets, covered, coverage: query terms (no stop words, two letters or more) found, by word or stem, in the hits' texts."""
    facets = queries.select("qid", F.explode("terms").alias("term")).filter((F.length("term") >= 2) & ~F.col("term").isin(vocab.STOP_WORDS))
    facets = facets.withColumn("key", F.explode(F.array_distinct(F.array("term", T.stem(F.col("term"))))))
    words = texts.join(F.broadcast(hits.select("qid", "path")), "path").select("qid", F.explode(T.distinct_tokens(F.col("body"))).alias("w")).distinct()
    words = words.select("qid", F.explode(F.array("w", T.stem(F.col("w")))).alias("key")).distinct()
    per = facets.join(words.withColumn("hit", F.lit(1)), ["qid", "key"], "left").groupBy("qid", "term").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    out = per.groupBy("qid").agg(F.count("*").alias("facets"), F.sum("hit").alias("covered"))
    return queries.select("qid").join(out, "qid", "left").select("qid", F.coalesce("facets", F.lit(0)).alias("facets"), F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce(F.col("covered") / F.col("facets"), F.lit(0.0)), 6).alias("coverage"))


#: Numbers as claims state them, a comma or a point before the decimals; words that state a conflict. (Fixed values.)
NUMBER = r"(?<![A-Za-z0-9_])[0-9]+(?:[.,][0-9]+)?(?![A-Za-z0-9_])"
CONFLICT = r"(?i)(?<![A-Za-z0-9_])(?:contradict|conflict|earlier decision|legacy window|contradd|conflitt)"


def contradictions(pages: DataFrame) -> DataFrame:
    """request_id, pages, numbers, explicit, contradiction: requests of two pages or more that state different numbers or a conflict."""
    found = pages.filter("request_id IS NOT NULL").select("request_id", "path", F.col("body").rlike(CONFLICT).alias("x"), F.explode_outer(F.transform(F.regexp_extract_all("body", F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit(".")))).alias("n"))
    g = found.groupBy("request_id").agg(F.countDistinct("path").alias("pages"), F.countDistinct("n").alias("numbers"), F.max("x").alias("explicit"))
    return g.withColumn("contradiction", (F.col("pages") >= 2) & ((F.col("numbers") >= 2) | F.col("explicit")))


def word_test(text: Column, words: list[str]) -> Column:
    """True if one of the words stands alone in the text (ASCII word limits)."""
    return F.lower(text).rlike(rf"(?<![a-z0-9_])({'|'.join(words)})(?![a-z0-9_])")


def required_types(text: Column) -> Column:
    """Page types that a query asks for, in a fixed order."""
    return F.array_compact(F.array(*(F.when(word_test(text, w), F.lit(t)) for t, w in vocab.REQUIRED_TYPE_WORDS.items())))


def gaps(facets: DataFrame, minimum: float = 0.6, sources: DataFrame | None = None, minimum_sources: int = 2) -> DataFrame:
    """qid, gaps: names of what a result lacks."""
    g = facets if sources is None else facets.join(sources, "qid", "left")
    parts = [F.when(F.col("coverage") < minimum, F.lit("query_facets"))]
    if sources is not None:
        parts.append(F.when(F.coalesce("n_sources", F.lit(0)) < minimum_sources, F.lit("source_diversity")))
    return g.select("qid", F.array_compact(F.array(*parts)).alias("gaps"))


def budget_limited(full: DataFrame, shown: DataFrame) -> DataFrame:
    """qid, limited: gaps of what is shown that the full result doesn't have."""
    return shown.select("qid", F.col("gaps").alias("s")).join(full, "qid").select("qid", F.array_join(F.array_except("s", "gaps"), ",").alias("limited"))
