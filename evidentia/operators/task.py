"""What the evidence of a task contradicts, lacks and touches.

hits: qid, path, rank, request_id, body, tags, sources, categories and shown (false for what was retrieved but not displayed).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fusion import NUMBER, word_test

# The categories that an intent's evidence must have, and what gaps call them.
REQUIRED = {
    "understand": ["currentState"],
    "implement": ["requirements", "invariants", "constraints", "dependencies", "tests"],
    "modify": ["affectedComponents", "dependencies", "requirements", "invariants", "tests", "incidents", "risks"],
    "debug": ["incidents", "tests", "implementationEvidence", "dependencies"],
    "review": ["requirements", "invariants", "tests", "risks"],
    "document": ["requirements"],
}
LABELS = {
    "currentState": "current state / architecture / concept", "requirements": "requirements", "decisions": "decisions", "invariants": "invariants",
    "constraints": "constraints", "dependencies": "interfaces and dependencies", "affectedComponents": "affected components",
    "implementationEvidence": "current implementation evidence", "tests": "tests and verification evidence",
    "incidents": "incidents and known failures", "risks": "known risks", "contradictions": "contradiction evidence",
}
#: Intents whose roots are inferred where none is named; categories that an impact lists; words of outdated pages. (Fixed values.)
IMPACT = ["implement", "modify", "debug", "review"]
IMPACT_PARTS = ["requirements", "decisions", "invariants", "tests", "incidents", "risks"]
STALE = ["stale", "obsolete", "outdated", "legacy_unverified"]


def _by_intent(table: dict, intent: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*pairs), intent)


def with_contradictions(hits: DataFrame) -> DataFrame:
    """Hits with `contradictions` among the categories of all pages of a request (two or more in a query) that state different
    numbers or of which one states a contradiction."""
    w = W.partitionBy("qid", "request_id")
    numbers = F.transform(F.regexp_extract_all("body", F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    # two different ones: the smallest isn't the largest
    h = hits.withColumns({"_lo": F.array_min(numbers), "_hi": F.array_max(numbers), "_said": F.array_contains("categories", "contradictions")})
    group = (F.coalesce("request_id", F.lit("")) != "") & (F.count("*").over(w) >= 2) & (F.coalesce(F.min("_lo").over(w) < F.max("_hi").over(w), F.lit(False)) | F.max("_said").over(w))
    return h.withColumn("categories", F.when(group, F.array_union("categories", F.array(F.lit("contradictions")))).otherwise(F.col("categories"))).drop("_lo", "_hi", "_said")


def with_drift(hits: DataFrame, drift: DataFrame) -> DataFrame:
    """Hits with claim_ids (sorted; null if fresh) and stale_reason of the drift entries (path, claim_id, reason) of their pages."""
    d = drift.groupBy("path").agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"), F.when(F.max(F.col("reason") == "anchor_unresolvable"), "anchor_unresolvable").otherwise("drift_suspected").alias("stale_reason"))
    return hits.join(d, "path", "left")


def buckets(hits: DataFrame) -> DataFrame:
    """qid, category, path, rank of what is shown and not stale."""
    return hits.filter("shown AND claim_ids IS NULL").select("qid", F.explode("categories").alias("category"), "path", "rank")


def _listed(column: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), ", ")


def gaps(queries: DataFrame, hits: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """qid, kind, reason, description. queries: qid, intent, requested (paths), omitted (number of hits dropped for the budget), budget;
    hits as after with_drift; coverage: qid, gap, limited (found, but not displayed). A gap is told once."""
    q = queries.select("qid", "intent", "requested", "omitted", "budget")
    none = F.lit(None).cast("string")
    told = lambda df, kind, text, reason=none: df.select("qid", kind.alias("kind"), reason.alias("reason"), text.alias("description"))
    fresh = F.col("claim_ids").isNull()
    parts = []
    if coverage is not None:
        kind = F.when(F.col("gap").contains("contradiction"), "contradiction").when(F.col("gap").contains("stale"), "stale_evidence").when(F.col("gap").rlike("budget|truncated"), "budget_limited").otherwise("missing_evidence")
        parts.append(told(coverage.filter("NOT limited"), kind, F.concat(F.lit("Hybrid coverage gap: "), "gap", F.lit("."))))
        parts.append(told(coverage.filter("limited"), F.lit("budget_limited"), F.concat(F.lit("Hybrid coverage evidence was retrieved but omitted by the display budget: "), "gap", F.lit("."))))
    # categories that the intent needs
    c = hits.withColumn("category", F.explode("categories")).groupBy("qid", "category").agg(
        F.max(fresh & F.col("shown")).alias("here"), F.max(fresh).alias("beyond"), F.max(~fresh & F.col("shown")).alias("stale_here"),
        F.max(F.coalesce(F.col("stale_reason") == "anchor_unresolvable", F.lit(False))).alias("lost"), F.array_join(F.sort_array(F.collect_set(F.when(~fresh, F.col("path")))), ", ").alias("stale"),
    )
    need = q.select("qid", "intent", F.explode(_by_intent(REQUIRED, F.col("intent"))).alias("category")).join(c, ["qid", "category"], "left").filter(~F.coalesce("here", F.lit(False)))
    label = F.try_element_at(F.create_map(*(F.lit(x) for p in LABELS.items() for x in p)), F.col("category"))
    beyond, stale = F.coalesce("beyond", F.lit(False)), F.coalesce("stale", F.lit("")) != ""
    parts.append(told(need.filter(beyond), F.lit("budget_limited"), F.concat(label, F.lit(" was retrieved but omitted by the display budget for intent "), "intent", F.lit("."))))
    parts.append(told(need.filter(~beyond & stale & ~F.coalesce("stale_here", F.lit(False))), F.lit("stale_evidence"), F.concat(label, F.lit(" is covered only by stale evidence that requires re-verification for intent "), "intent", F.lit(": "), "stale", F.lit(".")), F.when(F.col("lost"), "anchor_unresolvable").otherwise("drift_suspected")))
    parts.append(told(need.filter(~beyond & ~stale), F.lit("missing_evidence"), F.concat(F.lit("No "), label, F.lit(" was recovered for intent "), "intent", F.lit("."))))
    # components named in the request
    asked = q.select("qid", F.explode("requested").alias("path")).join(hits.groupBy("qid", "path").agg(F.max("shown").alias("shown")), ["qid", "path"], "left").filter(~F.coalesce("shown", F.lit(False)))
    parts.append(told(asked.filter("shown IS NOT NULL"), F.lit("budget_limited"), F.concat(F.lit("Requested changed component was retrieved but omitted by the display budget: "), "path", F.lit("."))))
    parts.append(told(asked.filter("shown IS NULL"), F.lit("missing_evidence"), F.concat(F.lit("Requested changed component was not recovered by the bounded hybrid path: "), "path", F.lit("."))))
    # what is shown but may not hold
    shown = hits.filter("shown")
    old = shown.filter(word_test(F.concat_ws(" ", F.array_join("tags", " "), "body"), STALE)).groupBy("qid").agg(_listed("path").alias("paths"))
    parts.append(told(old, F.lit("stale_evidence"), F.concat(F.lit("Potentially stale evidence requires validation: "), "paths", F.lit("."))))
    drifted = shown.filter("claim_ids IS NOT NULL").groupBy("qid", "stale_reason").agg(_listed("path").alias("paths"))
    what = F.when(F.col("stale_reason") == "drift_suspected", "Code-backed evidence changed").otherwise("Code-backed evidence could not be resolved safely")
    parts.append(told(drifted, F.lit("stale_evidence"), F.concat(what, F.lit(" and requires re-verification: "), "paths", F.lit(".")), F.col("stale_reason")))
    against = buckets(hits).filter("category = 'contradictions'").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ", ").alias("paths"))
    parts.append(told(against, F.lit("contradiction"), F.concat(F.lit("Conflicting evidence requires resolution: "), "paths", F.lit("."))))
    sourced = hits.filter(F.size("sources") > 0).groupBy("qid").agg(F.max("shown").alias("here"))
    bare = q.filter("intent = 'document'").join(sourced, "qid", "left").filter(~F.coalesce("here", F.lit(False)))
    parts.append(told(bare, F.when(F.col("here").isNull(), "missing_evidence").otherwise("budget_limited"), F.when(F.col("here").isNull(), "No source provenance was recovered for the document task.").otherwise("Source provenance was retrieved but omitted by the display budget for the document task.")))
    parts.append(told(q.filter("omitted > 0"), F.lit("budget_limited"), F.concat(F.col("omitted").cast("string"), F.lit(" evidence item(s) omitted to respect the "), F.col("budget").cast("string"), F.lit("-token heuristic task-context budget."))))
    return reduce(DataFrame.unionByName, parts).distinct()


def impact(queries: DataFrame, hits: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, part, path: changedComponents (the requested pages that are shown; where none is requested and the intent has an impact,
    the best shown component, else the best shown page), incoming and outgoing dependencies among what is shown, and the pages of
    each category that are linked with a root or belong to its request. edges: src, dst as page paths."""
    shown = hits.filter("shown")
    q = queries.select("qid", "intent", "requested")
    named = q.select("qid", F.explode("requested").alias("path")).join(shown.select("qid", "path", "request_id"), ["qid", "path"], "left_semi")
    best = F.min(F.struct(F.when(F.array_contains("categories", "affectedComponents"), 0).otherwise(1).alias("k"), "rank", "path"))
    inferred = q.filter((F.size("requested") == 0) & F.col("intent").isin(IMPACT)).join(shown, "qid").groupBy("qid").agg(best.alias("b")).select("qid", F.col("b.path").alias("path"))
    roots = named.unionByName(inferred).distinct()
    one = shown.select("qid", F.col("path").alias("src"))
    among = edges.select("src", "dst").filter("src <> dst").distinct().join(one, "src").join(one.withColumnRenamed("src", "dst"), ["qid", "dst"])
    root = roots.withColumnRenamed("path", "root")
    into = among.join(root, ["qid"]).filter("dst = root").select("qid", F.lit("incomingDependencies").alias("part"), F.col("src").alias("path"))
    out = among.join(root, ["qid"]).filter("src = root").select("qid", F.lit("outgoingDependencies").alias("part"), F.col("dst").alias("path"))
    requests = roots.join(shown.select("qid", "path", "request_id"), ["qid", "path"]).filter("request_id <> ''").select("qid", "request_id")
    related = roots.unionByName(into.select("qid", "path")).unionByName(out.select("qid", "path")).unionByName(shown.join(requests, ["qid", "request_id"], "left_semi").select("qid", "path")).distinct()
    listed = buckets(hits).filter(F.col("category").isin(IMPACT_PARTS)).join(related, ["qid", "path"], "left_semi").select("qid", F.col("category").alias("part"), "path")
    return roots.select("qid", F.lit("changedComponents").alias("part"), "path").unionByName(into).unionByName(out).unionByName(listed).distinct()
