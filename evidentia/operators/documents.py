"""Documents: template sections, section packs, report sections, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def sections(docs: DataFrame, level: int = 2) -> DataFrame:
    """path, place, title, text of documents (path, body) at headings of `level`; what stands before the first has an empty title. Fenced
    code doesn't start a section."""
    mark = "#" * level
    lines = docs.select("path", F.posexplode(F.split("body", "\r?\n")).alias("at", "line"))
    order = W.partitionBy("path").orderBy("at")
    lines = lines.withColumn("_fence", F.sum(F.when(F.col("line").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(order) % 2)
    lines = lines.withColumn("_head", F.when((F.col("_fence") == 0) & F.col("line").rlike(rf"^{mark}\s+\S"), F.regexp_replace("line", rf"^{mark}\s+|\s+$", "")))
    lines = lines.withColumn("place", F.count("_head").over(order)).withColumn("title", F.coalesce(F.last("_head", ignorenulls=True).over(order), F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_head").isNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("path", "place", "title").agg(F.trim(body).alias("text"))
    return out.filter("place > 0 OR text <> ''")


def template_sections(templates: DataFrame) -> DataFrame:
    """path, place, title, required of templates (path, body): a section is optional if its title says so."""
    s = sections(templates).filter("place > 0")
    return s.select("path", "place", F.trim(F.regexp_replace("title", r"(?i)\((optional|opzionale)\)", "")).alias("title"), (~F.col("title").rlike(r"(?i)\((optional|opzionale)\)")).alias("required"))


def plan(templates: DataFrame, hits: DataFrame, per_section: int = 3) -> DataFrame:
    """template, place, title, path, rank: the best hits (qid = place of a section, path, rank) for each section of a template."""
    t = template_sections(templates).withColumnRenamed("path", "template")
    return t.join(hits.filter(F.col("rank") <= per_section).withColumnRenamed("qid", "place"), "place", "left").select("template", "place", "title", "path", "rank")


def packed_passages(passages: DataFrame, budget: int) -> DataFrame:
    """qid, path, pos, text: passages (qid, path, pos, score, text) taken by score while they fit a page's characters, told in document order."""
    order = W.partitionBy("qid", "path").orderBy(F.desc("score"), "pos").rowsBetween(W.unboundedPreceding, 0)
    p = passages.withColumn("_used", F.sum(F.length("text")).over(order))
    return p.filter(F.col("_used") <= budget).select("qid", "path", "pos", "text").orderBy("qid", "path", "pos")


def covered_sections(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, state, chars: COVERED if a section (qid) has a passage, else GAP."""
    got = packs.groupBy("qid").agg(F.sum(F.length("text")).alias("chars"))
    return wanted.select("qid").join(got, "qid", "left").select("qid", F.when(F.col("chars") > 0, "COVERED").otherwise("GAP").alias("state"), F.coalesce("chars", F.lit(0)).alias("chars"))


def sufficiency(docs: DataFrame, minimum: int) -> DataFrame:
    """path, title, chars, enough: length of each section's plain text (links, marks and code left out)."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", " "), r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`#>|]", " ")
    s = sections(docs).filter("place > 0").withColumn("chars", F.length(T.squeezed(plain)))
    return s.select("path", "title", "chars", (F.col("chars") >= minimum).alias("enough"))


def report_drafts(reports: DataFrame, roles: dict[str, str]) -> DataFrame:
    """path, type, title, text: page drafts from the sections of development reports, by section title (folded) to page type."""
    pairs = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    s = sections(reports).filter("place > 0").withColumn("type", pairs[F.lower("title")])
    return s.filter("type IS NOT NULL AND text <> ''").select("path", "type", "title", "text")


def graph_summary(nodes: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """line: a Markdown report on a graph, counts by kind and the first relations."""
    counts = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(0).alias("o"), F.concat(F.lit("- "), F.col("kind"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    some = edges.orderBy("src", "kind", "dst").limit(limit).select(F.lit(1).alias("o"), F.concat(F.lit("- "), F.col("src"), F.lit(" --"), F.col("kind"), F.lit("--> "), F.col("dst")).alias("line"))
    return counts.unionByName(some).orderBy("o", "line").select("line")
