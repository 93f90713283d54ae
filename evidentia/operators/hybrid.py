"""Hybrid retrieval of many queries at once: lexical, semantic and graph lists fused, widened level by level while the
shown evidence lacks something. A level runs on the queries that are still open."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import coverage, fusion, graph, lexical
from .kept import kept


@dataclass(frozen=True)
class Budget:
    seeds: int
    nodes: int
    depth: int
    evidence: int
    tokens: int


def initial_budget(k: int) -> Budget:
    return Budget(min(8, max(k, 4)), max(6 * k, 48), 1, k, max(2000, 200 * k))


def maximum_budget(first: Budget, k: int) -> Budget:
    return Budget(max(first.seeds, min(32, 4 * first.seeds)), 4 * first.nodes, max(first.depth, min(3, first.depth + 3)), max(first.evidence, k), max(first.tokens, 2 * first.tokens, 256 * k))


def level_budget(first: Budget, most: Budget, level: int) -> Budget:
    """The first budget; seeds and nodes doubled, depth one more, evidence and tokens by half more; then the maximum."""
    if level == 0:
        return first
    if level >= 2:
        return most
    more = lambda x, by: max(x + 1, -(-x * by // 2))
    return Budget(min(most.seeds, more(first.seeds, 4)), min(most.nodes, more(first.nodes, 4)), min(most.depth, first.depth + 1), min(most.evidence, more(first.evidence, 3)), min(most.tokens, more(first.tokens, 3)))


def lexical_pool(index, asked: DataFrame, level: int, pool: int, profile: str, page_types: list[str] | None, extra: DataFrame | None) -> DataFrame:
    """qid, path, score, rank: the lists of a query and, from level 2, of its first four entities, each by its best score plus
    a reciprocal rank, summed by page. `extra` (qid, path, score, rank) is one list more."""
    texts = F.array("text") if level < 2 else F.array_distinct(F.concat(F.array("text"), F.slice("entities", 1, 4)))
    variants = asked.select("qid", F.posexplode(texts).alias("v", "t")).select(F.struct("qid", "v").alias("qid"), T.distinct_tokens(F.col("t")).alias("terms"))
    lists = lexical.bm25(index, variants, profile="coverage" if level >= 2 else profile, page_types=page_types, k=pool).select("qid", "path", "score", "rank")
    if extra is not None:
        lists = lists.unionByName(extra.select(F.struct("qid", F.lit(-1).alias("v")).alias("qid"), "path", F.col("score").cast("double").alias("score"), "rank"))
    best = F.max("score").over(W.partitionBy("qid"))
    each = lists.select(F.col("qid.qid").alias("q"), "path", (F.coalesce(F.col("score") / F.when(best > 0, best), F.lit(0.0)) + 1 / (vocab.FUSION_K + F.col("rank"))).alias("s"))
    merged = each.groupBy(F.col("q").alias("qid"), "path").agg(F.round(F.sum("s"), 9).alias("score"))
    return _ranked(merged).filter(F.col("rank") <= pool)


def _ranked(df: DataFrame, *first) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*first, F.desc("score"), "path")))


def seeds(lex: DataFrame, sem: DataFrame, most: int) -> DataFrame:
    """qid, path, score (best 1): the lexical list's head, or where a query has semantic hits the head of both lists' reciprocal ranks."""
    both = lex.select("qid", "path", fusion.reciprocal(F.col("rank")).alias("s")).unionByName(sem.select("qid", "path", fusion.reciprocal(F.col("rank"), vocab.SEMANTIC_WEIGHT).alias("s")))
    meant = sem.select("qid").distinct()
    mixed = both.join(meant, "qid", "left_semi").groupBy("qid", "path").agg(F.round(F.sum("s"), 12).alias("score"))
    head = _ranked(mixed.unionByName(lex.join(meant, "qid", "left_anti").select("qid", "path", "score"))).filter(F.col("rank") <= most)
    return head.select("qid", "path", (F.col("score") / F.greatest(F.max("score").over(W.partitionBy("qid")), F.lit(1e-9))).alias("score"))


def attempt(index, pages: DataFrame, edges: DataFrame, kinds: DataFrame, asked: DataFrame, sem: DataFrame, budget: Budget, level: int, *, adj: DataFrame | None = None, k: int, profile: str, page_types: list[str] | None, extra: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(all fused hits, those within the budget): qid, path, score, rank, and the lists' ranks r_lex, r_sem, r_graph."""
    times = (1, 2, 4)[min(level, 2)]
    lex = kept(lexical_pool(index, asked, level, max(k, max(4 * k, 20)) * times, profile, page_types, extra))
    start = kept(seeds(lex, sem, budget.seeds).select("qid", F.concat(F.lit("page:"), "path").alias("node"), "score"))
    walked = graph.expand_exact(edges, kinds, start, adj=adj, max_nodes=max(1, min(budget.nodes, max(3 * k, 24) * times)), depth=budget.depth, beam=max(1, min(budget.nodes, max(2 * k, 16) * times)), max_visited=budget.nodes)
    met = walked.join(start.select("qid", "node"), ["qid", "node"], "left_anti").filter("node LIKE 'page:%'").select("qid", F.substring("node", 6, 1 << 30).alias("path"), "place")
    if page_types is not None:
        met = met.join(pages.filter(F.col("type").isin(page_types)).select("path"), "path", "left_semi")
    near = met.withColumn("r_graph", F.row_number().over(W.partitionBy("qid").orderBy("place"))).drop("place")
    conf = F.least(F.lit(1.0), F.col("score") / F.greatest(F.max("score").over(W.partitionBy("qid")), F.lit(1e-9)))
    all_ = lex.select("qid", "path", F.col("rank").alias("r_lex"), conf.alias("conf")).join(sem.select("qid", "path", F.col("rank").alias("r_sem")), ["qid", "path"], "full").join(near, ["qid", "path"], "full")
    own = F.coalesce("conf", F.lit(0.0))
    score = fusion.reciprocal(F.col("r_lex")) * (0.2 + 0.8 * own) + fusion.reciprocal(F.col("r_sem"), vocab.SEMANTIC_WEIGHT) + fusion.reciprocal(F.col("r_graph"), vocab.GRAPH_WEIGHT) * F.when(F.col("r_lex").isNotNull(), 0.25 + 0.75 * own).otherwise(1.0)
    # a query that names something exactly keeps its best lexical page in front of what is only meant
    exact = asked.filter(coverage.exact_signal(F.col("text"))).join(sem.select("qid").distinct(), "qid", "left_semi").select("qid", F.lit(True).alias("exact"))
    all_ = all_.join(exact, "qid", "left").withColumn("score", F.round(score, 9))
    fused = _ranked(all_, F.desc(F.coalesce(F.col("exact") & (F.col("r_lex") == 1), F.lit(False)))).select("qid", "path", "score", "rank", "r_lex", "r_sem", "r_graph")
    # the texts of other pages aren't shuffled to meet the hits
    fused = kept(fused)
    full = pages.join(F.broadcast(fused.select("path").distinct()), "path", "left_semi").join(F.broadcast(fused), "path")
    bytes_ = F.octet_length(F.concat_ws(" ", "title", "type", "heading", "excerpt", F.array_join("sources", " ")))
    sized = full.filter(F.col("rank") <= min(k, budget.evidence)).withColumn("bytes", bytes_ + 1)
    order = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = sized.withColumn("used", F.ceil((F.sum("bytes").over(order) - 1) / 3))
    over = F.max(F.when((F.col("used") > budget.tokens) & (F.col("rank") > 1), 1).otherwise(0)).over(order)
    return full, sized.withColumn("over", over).filter("over = 0").drop("over", "bytes", "used")


def retrieve(index, pages: DataFrame, edges: DataFrame, kinds: DataFrame, queries: DataFrame, semantic: DataFrame | None = None, *, k: int = 10, first: Budget | None = None, most: Budget | None = None, profile: str = "balanced", page_types: list[str] | None = None, fallback: Callable[[DataFrame, DataFrame], DataFrame] | None = None, max_level: int = 3, meanings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, reports) of queries (qid, text): hits are qid, path, rank, score, level; reports are `coverage.assess` with level.

    pages: path, title, type, tags, sources, request_id, heading, excerpt, body. semantic: qid, path, rank of the provider's
    list; a query without rows there is searched by words and graph alone. Level 3 asks `fallback(open queries,
    their reports)` for one more list (qid, path, score, rank). The profile "coverage" spends every level.
    """
    first = first or initial_budget(k)
    most = most or maximum_budget(first, k)
    levels = min(3 if fallback else 2, max(0, max_level))
    asked = kept(coverage.requirements(queries))
    sem = kept(semantic) if semantic is not None else asked.select("qid", F.lit("").alias("path"), F.lit(0).alias("rank")).limit(0)
    open_, hits, reports, last = asked, None, None, None
    adj = graph.walkable(edges, kinds)
    for level in range(levels + 1):
        extra = fallback(open_, last) if level == 3 else None
        here = sem.join(open_.select("qid"), "qid", "left_semi")
        full, shown = attempt(index, pages, edges, kinds, open_, here, level_budget(first, most, level), level, adj=adj, k=k, profile=profile, page_types=page_types, extra=extra)
        full, shown = kept(full), kept(shown)
        last = kept(coverage.assess(open_, full, shown, meanings).withColumn("level", F.lit(level)))
        done = last.select("qid") if level == levels else last.filter("sufficient").select("qid") if profile != "coverage" else last.select("qid").limit(0)
        part = shown.join(done, "qid", "left_semi").select("qid", "path", "rank", "score", F.lit(level).alias("level"))
        told = last.join(done, "qid", "left_semi")
        hits, reports = (part, told) if hits is None else (hits.unionByName(part), reports.unionByName(told))
        open_ = kept(open_.join(done, "qid", "left_anti"))
        if level < levels and open_.isEmpty():
            break
    return hits, reports
