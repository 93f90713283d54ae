"""Inventories, catalogues, histograms, percentiles and plans of synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab


def under(path: Column, prefix: str) -> Column:
    """True for a path that is the prefix or lies under it."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def by_type(pages: DataFrame) -> DataFrame:
    return pages.groupBy("type").agg(F.count("*").alias("n"))


def catalogue(pages: DataFrame, types: list[str] = vocab.PAGE_TYPES) -> DataFrame:
    """place, type, title, path: types in their fixed order (unknown ones last), then titles; places are counted within a type."""
    order = F.when(F.array_position(F.array(*map(F.lit, types)), F.col("type")) > 0, F.array_position(F.array(*map(F.lit, types)), F.col("type"))).otherwise(len(types) + 1)
    place = F.row_number().over(W.partitionBy("type").orderBy("title", "path"))
    return pages.select(order.alias("type_order"), "type", place.alias("place"), "title", "path")


def pages_of_sources(pages: DataFrame) -> DataFrame:
    """source, pages: how many pages and the first of them cite a source."""
    return pages.select("path", F.explode("sources").alias("source")).groupBy("source").agg(F.countDistinct("path").alias("pages"), F.min("path").alias("first_path"))


def source_coverage(pages: DataFrame, coverage: DataFrame) -> DataFrame:
    """path, coverage: mean coverage (percent) of the sources that a page cites; a source without a ledger counts as 0."""
    refs = pages.select("path", F.explode("sources").alias("source")).distinct()
    return refs.join(coverage.select("source", "percent"), "source", "left").groupBy("path").agg(F.round(F.avg(F.coalesce("percent", F.lit(0.0))), 4).alias("coverage"))


def percentiles(values: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles per group: p50, p95, p99. Exact: distinct values are counted before they are ranked."""
    c = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    run = c.withColumn("_to", F.sum("_n").over(W.partitionBy(group).orderBy(value))).withColumn("_all", F.sum("_n").over(W.partitionBy(group)))
    at = lambda q: F.min(F.when(F.col("_to") >= F.greatest(F.ceil(q * F.col("_all")), F.lit(1)), F.col(value))).alias(f"p{round(q * 100)}")
    return run.groupBy(group).agg(*(at(q) for q in shares))


def assessment(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state of an old against a new list of files (path, raw): exact, line_endings, changed, missing, added."""
    norm = lambda c: F.sha2(F.regexp_replace(c, "\r\n?", "\n"), 256)
    a = old.select("path", F.sha2("raw", 256).alias("_a"), norm("raw").alias("_an"))
    b = new.select("path", F.sha2("raw", 256).alias("_b"), norm("raw").alias("_bn"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "exact").when(F.col("_an") == F.col("_bn"), "line_endings").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def synthesis_plan(claims: DataFrame, resolved: DataFrame, target: Column) -> DataFrame:
    """page, claims, block: what a page's managed block would hold, its claims in order of id; contradicted, duplicate and ambiguous ones stay out."""
    c = claims.join(resolved, "claim_id").filter(F.col("disposition").isin("candidate_update", "candidate_new_page", "supersedes")).withColumn("page", target)
    rows = F.array_sort(F.collect_list(F.struct("claim_id", "text")))
    return c.groupBy("page").agg(F.count("*").alias("claims"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["text"], F.lit(" ("), r["claim_id"], F.lit(")"))), "\n").alias("block"))


def closed(events: DataFrame, closings: DataFrame) -> DataFrame:
    """Recovery events with status resolved where a closing (recovery_id, ts) is not before their last use; closing twice changes nothing."""
    c = closings.groupBy("recovery_id").agg(F.max("ts").alias("_closed"))
    return events.join(c, "recovery_id", "left").withColumn("status", F.when(F.col("_closed") >= F.col("last_seen"), "resolved").otherwise(F.col("status"))).drop("_closed")


def most_drifted(entries: DataFrame, cited: DataFrame, limit: int = 20) -> DataFrame:
    """anchor_id, path, reason, citations of drifted anchors, the most cited first (citations: anchor_id)."""
    n = cited.groupBy("anchor_id").agg(F.count("*").alias("citations"))
    return entries.filter("verdict = 'drift_suspected'").join(n, "anchor_id", "left").select("anchor_id", "path", "reason", F.coalesce("citations", F.lit(0)).alias("citations")).orderBy(F.desc("citations"), "path").limit(limit)
