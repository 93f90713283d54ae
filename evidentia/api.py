"""The engine's calls by tool: one object over a page table, its postings, graph, ledger, claims and code fragments.

Every call takes and returns DataFrames; `state` names what a caller may do next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import code, context, evidence, fusion, governance, graph, lexical, moves
from .sources import code as code_files
from .sources import pages as page_files


@dataclass
class Limits:
    """Defaults of the calls."""

    results: int = 10
    nodes: int = 12
    depth: int = 1
    evidence: int = 8
    tokens: int = 2000
    code_results: int = 12
    segment_chars: int = 12_000


@dataclass
class Workspace:
    spark: SparkSession
    pages: DataFrame
    files: DataFrame | None = None
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def open(cls, spark: SparkSession, root: str, code_root: str | None = None) -> Workspace:
        """Pages (and code files) under folders."""
        return cls(spark, page_files.records(page_files.read(spark, root)), None if code_root is None else code_files.read(spark, code_root))

    # context
    def query(self, text: str, qid: int = 1) -> DataFrame:
        return self.spark.createDataFrame([(qid, text)], "qid long, text string").select("qid", T.distinct_tokens(F.col("text")).alias("terms"))

    def search(self, text: str, profile: str = "balanced", types: list[str] | None = None) -> DataFrame:
        if not text.strip():
            return self.list()
        return lexical.bm25(self.pages, self.query(text), profile=profile, page_types=types, k=self.limits.results)

    def list(self) -> DataFrame:
        return lexical.list_pages(self.pages)

    def graph_edges(self) -> DataFrame:
        return graph.metadata_edges(self.pages).unionByName(graph.role_edges(self.pages)).unionByName(self.link_edges()).dropDuplicates(["src", "kind", "dst"])

    def link_edges(self) -> DataFrame:
        page = lambda c: F.concat(F.lit("page:"), F.col(c))
        return graph.resolved_links(self.pages).filter("resolved IS NOT NULL AND resolved <> path").select(page("path").alias("src"), F.lit("links_to").alias("kind"), page("resolved").alias("dst"))

    def subgraph(self, text: str) -> DataFrame:
        best = self.search(text)
        seeds = best.select("qid", F.concat(F.lit("page:"), F.col("path")).alias("node"), (F.col("score") / F.max("score").over(_all())).alias("score"))
        return graph.expand_exact(self.graph_edges(), graph.nodes(self.pages).select(F.col("id").alias("node"), "kind"), seeds, max_nodes=self.limits.nodes, depth=self.limits.depth)

    def hybrid(self, text: str, semantic: DataFrame | None = None) -> DataFrame:
        """Lexical, semantic (qid, path, rank; none if there is no provider) and graph lists fused."""
        lex = self.search(text)
        near = self.subgraph(text).filter("node LIKE 'page:%'").select("qid", F.substring("node", 6, 1 << 30).alias("path"), F.col("place").alias("rank")).join(lex.select("qid", "path"), ["qid", "path"], "left_anti")
        none = lex.select("qid", "path", "rank").limit(0)
        return fusion.hybrid(lex, none if semantic is None else semantic, near)

    def task(self, objective: str, intent: str = "understand") -> DataFrame:
        """qid, path, place, categories: evidence for an objective, ordered by what the intent wants first, within the token budget."""
        hits = self.hybrid(objective).filter(F.col("rank") <= self.limits.evidence).join(self.pages.select("path", "type", "tags", "body"), "path")
        hits = hits.withColumn("categories", context.categories(F.col("type"), F.array_join("tags", " "), F.col("body"))).withColumn("tokens", T.estimated_tokens(F.col("body")))
        order = context.ordered(hits, intent).join(hits.select("qid", "path", "categories", "tokens"), ["qid", "path"]).withColumnRenamed("place", "rank")
        return fusion.within_budget(order, "tokens", self.limits.tokens).select("qid", "path", F.col("rank").alias("place"), "categories")

    def traceability(self) -> DataFrame:
        return governance.traceability(self.pages)

    # pages
    def read(self, uris: DataFrame) -> DataFrame:
        return page_files.resolved(uris, self.pages, page_files.passages(self.pages))

    def write(self, changes: DataFrame) -> Workspace:
        """A workspace with pages put in or replaced (columns of pages)."""
        kept = self.pages.join(changes.select("path"), "path", "left_anti")
        return Workspace(self.spark, kept.unionByName(changes, allowMissingColumns=True), self.files, self.limits)

    def edit(self, path: str, old: str, new: str) -> Workspace:
        """Replaces a text that occurs once in a page's body; raises if it doesn't."""
        n = self.pages.filter(F.col("path") == path).select(((F.length("body") - F.length(F.replace("body", F.lit(old), F.lit("")))) / len(old)).alias("n")).first()
        if n is None or n["n"] != 1:
            raise ValueError(f"{path}: the text to replace occurs {0 if n is None else int(n['n'])} times")
        changed = F.when(F.col("path") == path, F.replace("body", F.lit(old), F.lit(new))).otherwise(F.col("body"))
        return Workspace(self.spark, self.pages.withColumn("body", changed), self.files, self.limits)

    def delete(self, path: str) -> Workspace:
        return Workspace(self.spark, self.pages.filter(F.col("path") != path), self.files, self.limits)

    def move(self, old: str, new: str) -> Workspace:
        """A page under another path, with the links to it and its own rewritten. This workspace stays as it is: go on with it to undo."""
        return Workspace(self.spark, moves.moved(self.pages, old, new), self.files, self.limits)

    def move_changes(self, old: str, new: str) -> DataFrame:
        """The references that a move would rewrite; nothing is changed."""
        return moves.link_changes(self.pages, old, new)

    def content_warnings(self, written: DataFrame) -> DataFrame:
        return moves.content_warnings(self.pages, written)

    # ingest
    def segments(self, sources: DataFrame) -> DataFrame:
        return evidence.segments(sources, self.limits.segment_chars)

    def next_segment(self, ledger: DataFrame) -> DataFrame:
        return ledger.filter("status = 'pending'").orderBy("source_uri", "seq").limit(1)

    def source_status(self, ledger: DataFrame) -> DataFrame:
        m = evidence.ledger_metrics(ledger)
        return m.withColumn("state", F.when(F.col("pending") > 0, "open").otherwise("fully_covered"))

    def apply_claims(self, claims: DataFrame, relations: DataFrame) -> DataFrame:
        """claim_id, disposition, status."""
        resolved = evidence.resolutions(claims, relations, self.pages)
        return resolved.join(evidence.statuses(claims, resolved, relations), "claim_id")

    # code
    def fragments(self) -> DataFrame:
        if self.files is None:
            raise ValueError("the workspace has no code files")
        return code_files.fragments(self.files)

    def code_search(self, text: str) -> DataFrame:
        return code.search(self.fragments(), text, self.limits.code_results)

    def code_symbol(self, name: str) -> DataFrame:
        return code.symbol(self.fragments(), name, self.limits.code_results)

    def code_references(self, name: str) -> DataFrame:
        return code.references(self.fragments(), self.spark.createDataFrame([(name,)], "target string"))

    # documents and administration
    def review(self, docs: DataFrame, sections: list[str]) -> DataFrame:
        return governance.review(docs, sections)

    def lint(self) -> DataFrame:
        """severity, code, path, detail of all findings, errors first."""
        found = governance.page_issues(self.pages).select("severity", "code", "path", F.lit("").alias("detail"))
        broken = graph.resolved_links(self.pages).filter("resolved IS NULL").select(F.lit("ERROR").alias("severity"), F.lit("BROKEN_LINK").alias("code"), "path", F.col("target").alias("detail"))
        twice = governance.duplicate_titles(self.pages).select(F.lit("WARN").alias("severity"), F.lit("DUPLICATE_TITLE").alias("code"), F.col("first_path").alias("path"), F.col("title").alias("detail"))
        alone = governance.orphans(self.pages).select(F.lit("INFO").alias("severity"), F.lit("ORPHAN").alias("code"), "path", F.lit("").alias("detail"))
        return found.unionByName(broken).unionByName(twice).unionByName(alone).orderBy("severity", "code", "path", "detail")

    def drift(self, anchors: DataFrame, parser_version: str = "v1") -> DataFrame:
        if self.files is None:
            raise ValueError("the workspace has no code files")
        return evidence.drift(anchors, self.files.withColumn("parser_version", F.lit(parser_version)))

    def manifest(self) -> DataFrame:
        return evidence.manifest(self.pages.select("path", F.col("body").alias("content")))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("qid")
