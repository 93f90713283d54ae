"""Search over code fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _has(value: Column, term: Column) -> Column:
    return F.coalesce(F.instr(F.lower(value), term) > 0, F.lit(False))


def _any(values: Column, term: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.instr(F.lower(v), term) > 0), F.lit(False))


# Points for where a term is found.
POINTS = {"path": 6, "definition": 6, "calls": 9, "refs": 5, "imports": 5, "config_keys": 12, "database_refs": 10, "doc_comment": 4}


def search(fragments: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Best fragments for a query: path, start_line, symbol, score; ties by path and line."""
    whole = query.strip().lower()
    terms = list(dict.fromkeys(t for t in whole.replace("(", " ").replace(")", " ").split() if t))
    f = fragments
    low = lambda c: F.lower(F.col(c))
    q = F.lit(whole)
    score: Column = F.when((low("symbol") == q) | (low("qualified_name") == q), 120).otherwise(0) + F.when(_has(F.col("symbol"), q) | _has(F.col("qualified_name"), q), 32).otherwise(0) + F.when(_has(F.col("path"), q), 16).otherwise(0)
    matched: Column = F.lit(0)
    for t in terms:
        term = F.lit(t)
        points: Column = F.when((low("symbol") == term) | (low("qualified_name") == term), 18).when(_has(F.col("symbol"), term) | _has(F.col("qualified_name"), term), 12).otherwise(0)
        for c, n in POINTS.items():
            if c in f.columns:
                test = _any(F.col(c), term) if dict(f.dtypes)[c].startswith("array") else _has(F.col(c), term)
                points = points + F.when(test, n).otherwise(0)
        if "routes" in f.columns:
            points = points + F.when(F.exists("routes", lambda r: F.instr(F.lower(F.concat_ws(" ", r["method"], r["path"])), term) > 0), 12).otherwise(0)
        score, matched = score + points, matched + F.when(points > 0, 1).otherwise(0)
    total = (score + matched / max(1, len(terms)) * 20) * F.when(F.col("kind") == "module", 0.72).otherwise(1.0)
    return f.select("path", "start_line", "symbol", F.round(total, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "path", "start_line").limit(limit)


def symbol(fragments: DataFrame, name: str, limit: int = 12) -> DataFrame:
    """Definitions of a name: qualified name 200, symbol 160, ending of the qualified name 80."""
    n = F.lower(T.qualified_symbol(F.lit(name)))
    own = F.lower(T.qualified_symbol(F.col("qualified_name")))
    score = F.when(own == n, 200).when(F.lower("symbol") == n, 160).when(F.endswith(own, F.concat(F.lit("."), n)), 80).otherwise(0)
    return fragments.select("path", "start_line", "symbol", "qualified_name", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "path", "start_line").limit(limit)


def references(fragments: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, start_line, how: fragments that call, name or import each target (column target): an equi-join on names."""
    how = lambda c, k: F.transform(F.col(c), lambda n: F.struct(F.lower(n).alias("n"), F.lit(k).alias("k")))
    used = fragments.select("path", "start_line", "symbol", F.explode(F.concat(how("calls", 0), how("refs", 1), how("imports", 2))).alias("u"))
    hit = used.join(targets.select("target", F.lower("target").alias("_t")), F.col("u.n") == F.col("_t")).filter(F.lower("symbol") != F.col("_t"))
    best = hit.groupBy("target", "path", "start_line").agg(F.min("u.k").alias("k"))
    return best.select("target", "path", "start_line", F.element_at(F.array(F.lit("call"), F.lit("reference"), F.lit("import")), F.col("k") + 1).alias("how"))


def fallback_demand(events: DataFrame) -> DataFrame:
    """extension, searches: histograms (map column extension_histogram) summed."""
    return events.select(F.explode("extension_histogram").alias("extension", "n")).groupBy("extension").agg(F.sum("n").alias("searches"))
