"""Lint, traceability, page validation and document review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from . import graph

#: Roles that every request should have a page for.
TRACED = ["request", "requirement", "implementation", "test_result", "release"]


def traceability(pages: DataFrame) -> DataFrame:
    """request_id, missing: roles without a page, joined by commas."""
    have = pages.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.collect_set("type").alias("have"))
    return have.select("request_id", F.array_join(F.array_except(F.array(*map(F.lit, TRACED)), "have"), ",").alias("missing"))


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    met = graph.resolved_links(pages).filter("resolved IS NOT NULL AND resolved <> path").select(F.col("resolved").alias("path"))
    return pages.select("path").join(met, "path", "left_anti")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """title (folded), n, first_path of titles on several pages."""
    return pages.groupBy(F.lower(F.trim("title")).alias("title")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def page_issues(pages: DataFrame) -> DataFrame:
    """path, severity, code of each finding on a page's fields."""
    found = [
        (F.coalesce(F.trim("title"), F.lit("")) == "", "ERROR", "MISSING_TITLE"),
        (~F.coalesce(F.col("type").isin(vocab.PAGE_TYPES), F.lit(False)), "ERROR", "INVALID_TYPE"),
        (F.coalesce(F.size("tags"), F.lit(0)) <= 0, "WARN", "MISSING_TAGS"),
        (F.coalesce(F.size("sources"), F.lit(0)) <= 0, "WARN", "MISSING_SOURCES"),
        (F.trim("body") == "", "ERROR", "EMPTY_FILE"),
    ]
    if "updated" in pages.columns:
        found.append((~F.coalesce(F.col("updated").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "ERROR", "INVALID_DATE"))
    issues = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for test, s, c in found)))
    return pages.select("path", F.explode(issues).alias("i")).select("path", "i.severity", "i.code")


#: Findings on a document's Markdown: code, severity, pattern that must not occur.
PATTERNS = [
    ("RAW_HTML_UNSAFE", "BLOCKER", r"(?i)<(script|iframe|object|embed)[\s>]"),
    ("LINK_UNSAFE_URI", "BLOCKER", r"(?i)\]\((javascript|vbscript|data):"),
    ("UNRESOLVED_PLACEHOLDER", "BLOCKER", r"(?i)\b(TODO|TBD|FIXME)\b|\{\{[^}]*\}\}"),
    ("RAW_HTML", "WARNING", r"(?i)<(div|span|table|br|p)[\s>/]"),
]


# What a client must not read, and spellings to look at, each with its label.
_WORD = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
INTERNAL = [
    ("wiki", "(?i)" + _WORD.format("wiki") + r"|wiki[_-][a-z_]+|wiki/"),
    ("context pack", r"(?i)context pack|pagina sorgente|pagine sorgenti|fonti frontmatter"),
    ("agent", "(?i)" + _WORD.format("agent") + "|" + _WORD.format("LLM") + r"|prompt|sub-agent|writer assegnato"),
    ("internal path", r"(?i)(?<![A-Za-z0-9_])(src|tests|docs|wiki)[\\/][A-Za-z0-9_./-]+"),
]
SPELLINGS = {"ital": [("qual è", "qual['’]è"), ("un po'", "un pò"), ("perché", "perchè"), ("poiché", "poichè"), ("affinché", "affinchè"), ("nonché", "nonchè"), ("se stesso", "sè stesso"), ("da luogo", "dà luogo")]}
MERMAID_KINDS = r"^(flowchart|graph|sequenceDiagram|erDiagram|classDiagram|stateDiagram(-v2)?|journey|gantt|pie|mindmap|timeline)(?![A-Za-z0-9_])"
MERMAID_ACTIVE = r"(?i)%%\s*\{|(^|[;\r\n])\s*(click|href|call|link)(?![A-Za-z0-9_])|https?:|javascript:|vbscript:|data:|</?(script|iframe|object|embed)(?![A-Za-z0-9_])|\son[a-z]+\s*="
PLAIN_LANGUAGES = ["mermaid", "json", "bash", "shell", "sh", "ts", "typescript", "js", "javascript", "yaml", "yml", "http", "text"]
#: A drawn box or arrow of an ASCII diagram.
DRAWN = r"──|-->|<--|\+[-+]{2,}|\|.*\|"
FENCE = r"(?ms)^```[ \t]*[A-Za-z]*[^\n]*\n.*?(?:^```[ \t]*$|\z)"


def review(docs: DataFrame, required: list[str], min_section: int = 40, *, language: str = "english", client_facing: bool = True, diagram_mode: str | None = None, private_scheme: str = "evidentia") -> DataFrame:
    """path, severity, code, detail for documents (path, body): patterns, private addresses, diagrams, wording for the client and the
    language, one first-level title, sections present and long enough."""
    body = F.concat(F.lit("\n"), "body")
    sections = F.filter(F.split(body, r"\n## +"), lambda s: s.isNotNull())
    heads = F.transform(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))), lambda s: F.lower(F.trim(F.split(s, "\n")[0])))
    short = F.filter(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))), lambda s: F.length(F.trim(F.regexp_replace(s, r"^[^\n]*\n?", ""))) < min_section)
    blocks = F.transform(F.regexp_extract_all("body", F.lit(FENCE), 0), lambda b: F.struct(F.lower(F.regexp_extract(b, r"^```[ \t]*([A-Za-z]*)", 1)).alias("language"), F.trim(F.regexp_replace(F.regexp_replace(b, r"^```[^\n]*\n", ""), r"(?m)^```[ \t]*$", "")).alias("text")))
    prose = F.regexp_replace("body", FENCE, "")
    mermaid = F.filter(blocks, lambda b: b["language"] == "mermaid")
    odd = lambda b: ~F.regexp_replace(b["text"], r"^\s+", "").rlike(MERMAID_KINDS) | (F.length(b["text"]) > 50_000) | b["text"].rlike(r"(?i)<[^>]+>|data:")
    one = lambda test, severity, code, detail=F.lit(""): F.when(test, F.array(F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail")))).otherwise(F.array().cast("array<struct<severity:string,code:string,detail:string>>"))
    many = lambda values, severity, code: F.transform(values, lambda v: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), v.alias("detail")))
    labels = lambda rules: F.array_join(F.array_compact(F.array(*(F.when(prose.rlike(p), F.lit(n)) for n, p in rules))), ", ")
    parts = [one(F.col("body").rlike(p), s, c) for c, s, p in PATTERNS]
    parts += [
        one(F.col("body").rlike(f"(?i){private_scheme}://"), "BLOCKER", "PRIVATE_RESOURCE_URI"),
        one(F.exists(mermaid, lambda b: b["text"].rlike(MERMAID_ACTIVE)), "BLOCKER", "MERMAID_UNSAFE"),
        one(F.exists(mermaid, odd), "WARNING", "MERMAID_INVALID"),
        one(F.exists(blocks, lambda b: ~b["language"].isin(PLAIN_LANGUAGES) & b["text"].rlike(DRAWN)), "WARNING", "ASCII_DIAGRAM"),
        one(F.regexp_count(body, F.lit(r"\n# +[^\n]")) != 1, "BLOCKER", "DOCUMENT_TITLE_CONTRACT"),
        one(F.size(sections) < 2, "BLOCKER", "DOCUMENT_SECTION_CONTRACT"),
        one(F.regexp_count(body, F.lit("\n```")) % 2 == 1, "WARNING", "UNCLOSED_CODE_FENCE"),
        many(F.array_except(F.array(*(F.lit(r.lower()) for r in required)), heads), "BLOCKER", "MISSING_SECTIONS"),
        many(F.transform(short, lambda s: F.lower(F.trim(F.split(s, "\n")[0]))), "WARNING", "WEAK_SECTIONS"),
    ]
    if diagram_mode in ("none", "external_asset"):
        alone = F.lit(True) if diagram_mode == "none" else F.regexp_count("body", F.lit(r"!\[[^\]]*\]\(")) == 0
        parts.append(one((F.size(mermaid) > 0) & alone, "WARNING", "DIAGRAM_MODE_MISMATCH"))
    if client_facing:
        parts.append(one(labels(INTERNAL) != "", "BLOCKER", "NON_CLIENT_FACING", labels(INTERNAL)))
    rules = [(n, rf"(?i)(^|[\s(\[\"]){p}(?=$|[\s),.;:!?])") for key, found in SPELLINGS.items() if key in language.lower() for n, p in found]
    if rules:
        parts.append(one(labels(rules) != "", "WARNING", "LANGUAGE_REVIEW", labels(rules)))
    return docs.select("path", F.explode(F.concat(*parts)).alias("f")).select("path", "f.*")


def ready(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """path, blockers, ready: a document may be delivered if it has no blocker."""
    n = findings.groupBy("path").agg(F.count_if(F.col("severity") == "BLOCKER").alias("blockers"))
    return docs.select("path").join(n, "path", "left").select("path", F.coalesce("blockers", F.lit(0)).alias("blockers"), (F.coalesce("blockers", F.lit(0)) == 0).alias("ready"))
