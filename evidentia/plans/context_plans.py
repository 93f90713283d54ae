"""Queries on task context, widening, code search, documents and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import code, context, fusion, governance, graph
from ..operators.kept import kept
from ..sources import code as code_files
from ..sources import corpus
from ..streaming import incremental
from .graph_plans import _ROLES, role_pages
from .stored import best_pages

NOTES = ["must never fail", "limit of two", "the schema", "plain words", "an outage", "a conflicting rule", "one contradicts another", "uncontradictsed"]


def noted_pages(spark, d):
    """Pages of all types, with a note and tags by id; stated rules."""
    p = role_pages(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return p.withColumn("type", pick(vocab.PAGE_TYPES, n)).withColumn("body", pick(NOTES, F.floor(n / 5))).withColumn("tags", F.array(F.when(n % 3 == 0, F.lit("regression test")).otherwise(F.lit("misc")))).withColumn("qid", F.floor(n / 20)).withColumn("rank", (n % 20 + 1).cast("int"))


def evidence_buckets(spark, d):
    return context.buckets(noted_pages(spark, d)).select("qid", "category", "path")


def evidence_order(spark, d):
    p = noted_pages(spark, d).withColumn("categories", context.categories(F.col("type"), F.array_join("tags", " "), F.col("body")))
    return context.ordered(p, "implement")


def impact_edges(spark, d):
    e = graph.role_edges(role_pages(spark, d))
    roots = role_pages(spark, d).filter("type = 'implementation'").select(F.concat(F.lit("page:"), "path").alias("root"))
    return context.impact(e, roots)


def graph_dependencies(spark, d):
    p = noted_pages(spark, d)
    return context.dependencies(graph.role_edges(role_pages(spark, d)), p.filter("rank <= 4"))


def progressive_widening(spark, d):
    """Queries whose best three hits don't cover their facets get ten."""
    p, q = corpus.pages(spark, d), corpus.queries(spark, d)
    attempt = lambda open_, b: best_pages(spark, d, open_, k=b["evidence"])
    enough = lambda hits: fusion.facet_coverage(hits.select("qid").distinct().join(q, "qid"), hits, p.select("path", "body")).filter("coverage >= 0.8")
    budgets = [{"evidence": 3}, {"evidence": 10}]
    return context.widened(q, attempt, enough, budgets).select("qid", "path", "rank", "level")


def parts_as_fragments(spark, d):
    """Parts as code fragments: the name is a symbol, the brand its file, the type its definition; a stated rule."""
    t = corpus.table(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "_")
    return t.select(F.concat(F.lit("src/"), F.regexp_replace(F.col("p_brand"), "[# ]", ""), F.lit(".ts")).alias("path"), F.col("p_partkey").cast("int").alias("start_line"), name.alias("symbol"), F.concat_ws(".", F.col("p_brand"), name).alias("qualified_name"), F.when(F.col("p_partkey") % 10 == 0, "module").otherwise("function").alias("kind"), F.col("p_type").alias("definition"), F.split("p_type", " ").alias("calls"), F.split("p_name", " ").alias("refs"), F.array("p_brand").alias("imports"))


#: Extension and text of a file that defines $N and calls $C, in six languages.
SOURCES = [
    (".ts", "// about it\nexport function $N(a) {\n  return $C(a);\n}\n"),
    (".java", "class K$N {\n  public int $N(int a) {\n    return $C(a); // f(x)\n  }\n}\n"),
    (".py", "def $N(a):\n    return $C(a)\n"),
    (".go", "package p\nfunc $N(a int) int {\n  return $C(a)\n}\n"),
    (".rs", "fn $N(a: i32) -> i32 {\n  $C(a)\n}\n"),
    (".rb", "def $N(a)\n  $C(a)\nend\n"),
]


def code_texts(spark, d):
    """Every part as a code file: its key names the symbol, its supplier-like rest the call; a stated rule."""
    k = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in SOURCES)), (k % len(SOURCES) + 1).cast("int"))
    text = F.replace(F.replace(pick(1), F.lit("$N"), F.concat(F.lit("fn"), k.cast("string"))), F.lit("$C"), F.concat(F.lit("fn"), (k % 97).cast("string")))
    return corpus.table(spark, d, "part").select(F.concat(F.lit("src/f"), k.cast("string"), pick(0)).alias("path"), text.alias("content"))


def _functions(fragments):
    return fragments.filter("kind = 'function'").select("path", "symbol", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


def code_fragments(spark, d):
    return _functions(code_files.fragments(code_texts(spark, d)))


def code_incremental(spark, d):
    """As `code_fragments`, brought up to date from an index of older texts of half of the files, some of them gone since."""
    now = code_texts(spark, d)
    n = F.length("path") % 2 == 0
    older = now.filter(n).withColumn("content", F.when(F.col("path").endswith("1.py"), F.lit("def old():\n    pass\n")).otherwise(F.col("content"))).unionByName(now.filter(n).withColumn("path", F.concat(F.lit("gone/"), "path")))
    return _functions(code_files.refreshed(now, kept(code_files.refreshed(older))))


def code_callers(spark, d):
    """Files with a function that calls one of three functions."""
    names = spark.createDataFrame([("fn1",), ("fn2",), ("fn96",)], "target string")
    return code.references(code_files.fragments(code_texts(spark, d)).filter("kind = 'function'"), names).filter("how = 'call'").select("target", "path").distinct()


def code_search(spark, d):
    return code.search(parts_as_fragments(spark, d), "brand steel", 25)


def code_symbol(spark, d):
    f = parts_as_fragments(spark, d)
    return code.symbol(f, "small_widget", 25).unionByName(code.symbol(f, "nothing_here", 25))


def code_references(spark, d):
    names = corpus.table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("target")).distinct()
    return code.references(parts_as_fragments(spark, d), names).groupBy("target", "how").agg(F.count("*").alias("n"))


def turn_documents(spark, d):
    """Every turn of the conversations as a Markdown document with a heading per role and, by its number, what a review must find; stated rules."""
    c = corpus.table(spark, d, "conversations")
    some = lambda n, k, text: F.when(F.col("conv_id") % n == k, F.lit(text)).otherwise(F.lit(""))
    body = F.concat(F.lit("# Title\n\n## "), F.coalesce("role", F.lit("x")), F.lit("\n"), F.coalesce("text", F.lit("")), *(some(*x) for x in ADDED))
    return c.select(F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), body.alias("body"))


#: (divisor, rest, text added to the documents of such conversations)
ADDED = [
    (3, 0, "\nTODO"), (4, 0, "\n# Second"), (5, 1, "\n```mermaid\nflowchart TD\nA-->B\n```"), (7, 0, "\n```mermaid\nclick here\n```"), (8, 1, "\n```\n+---+\n| a |\n```"),
    (6, 1, "\nsee wiki/page and the prompt"), (9, 2, "\nnon so perchè, un pò"), (10, 3, "\nevidentia://page/x"), (11, 4, "\n<div onclick=1>"),
]


def document_review(spark, d):
    return governance.review(turn_documents(spark, d), ["user"], language="Italian", diagram_mode="none")


def document_ready(spark, d):
    docs = turn_documents(spark, d)
    return governance.ready(governance.review(docs, ["user"], language="Italian"), docs)


def page_lint(spark, d):
    return governance.page_issues(corpus.pages(spark, d).withColumn("body", F.trim("body")))


def event_windows(spark, d):
    return incremental.windowed(corpus.table(spark, d, "events"))


def user_sessions(spark, d):
    return incremental.sessions(corpus.table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (evidence_buckets, evidence_order, impact_edges, graph_dependencies, progressive_widening, code_fragments, code_incremental, code_callers, code_search, code_symbol, code_references, document_review, document_ready, page_lint, event_windows, user_sessions)}

_NOTED = f"""{_ROLES}, noted AS (SELECT r.* EXCLUDE (type), {vocab.PAGE_TYPES!r}[doc_id % 20 + 1] AS type, doc_id // 20 AS qid, doc_id % 20 + 1 AS rank, {NOTES!r}[doc_id // 5 % 8 + 1] AS body, CASE WHEN doc_id % 3 = 0 THEN 'regression test' ELSE 'misc' END AS tags FROM roles r JOIN documents ON path = 'doc/' || lpad(doc_id::VARCHAR, 9, '0') || '.md')"""


def _word(x, key):
    return f"regexp_matches(lower({x}), '(^|[^a-z0-9_])({'|'.join(context.WORDS[key])})($|[^a-z0-9_])')"


_TESTS = {"currentState": f"type IN ({', '.join(map(repr, context.CURRENT_TYPES))})", "requirements": "type IN ('requirement', 'request', 'candidate_request')", "decisions": "type = 'decision'", "affectedComponents": f"type IN ({', '.join(map(repr, vocab.COMPONENT_TYPES))})", "implementationEvidence": f"type IN ({', '.join(map(repr, vocab.COMPONENT_TYPES))})", "tests": f"type = 'test_result' OR {_word('tags', 'tests')}", "invariants": _word("body", "invariants"), "constraints": _word("body", "constraints"), "dependencies": f"type IN ('api', 'integration', 'data_model', 'automation') OR {_word('body', 'dependencies')}", "incidents": f"type = 'analysis' AND {_word('body', 'incidents')}", "risks": f"type = 'risk' OR {_word('tags', 'risks')}", "contradictions": f"({_word('tags', 'contradictions')} OR {_word('body', 'conflicts')})"}
_ROLE_EDGES = f"""{_ROLES}, re AS (SELECT 'page:' || a.path AS src, CASE WHEN b.type = 'implementation' THEN 'implements' WHEN b.type = 'test_result' THEN 'tests' ELSE 'released_by' END AS kind, 'page:' || b.path AS dst
FROM roles a JOIN roles b USING (request_id) WHERE (a.type IN ('request', 'requirement') AND b.type = 'implementation') OR (a.type IN ('requirement', 'implementation') AND b.type = 'test_result') OR (a.type IN ('request', 'implementation') AND b.type = 'release'))"""
_PARTS = "fr AS (SELECT 'src/' || regexp_replace(p_brand, '[# ]', '', 'g') || '.ts' AS path, p_partkey::INTEGER AS start_line, replace(p_name, ' ', '_') AS symbol, p_brand || '.' || replace(p_name, ' ', '_') AS qualified_name, p_partkey % 10 = 0 AS module, p_type AS definition, string_split(p_type, ' ') AS calls, string_split(p_name, ' ') AS refs, p_brand AS imports FROM part)"


def _search_sql(query):
    has = lambda c, t: f"contains(lower({c}), '{t}')"
    q = query.lower()
    base = f"CASE WHEN lower(symbol) = '{q}' OR lower(qualified_name) = '{q}' THEN 120 ELSE 0 END + CASE WHEN {has('symbol', q)} OR {has('qualified_name', q)} THEN 32 ELSE 0 END + CASE WHEN {has('path', q)} THEN 16 ELSE 0 END"
    points = []
    for t in q.split():
        each = [f"CASE WHEN lower(symbol) = '{t}' OR lower(qualified_name) = '{t}' THEN 18 WHEN {has('symbol', t)} OR {has('qualified_name', t)} THEN 12 ELSE 0 END"]
        each += [f"CASE WHEN {has(c, t)} THEN {n} ELSE 0 END" for c, n in (("path", 6), ("definition", 6), ("imports", 5))]
        each += [f"CASE WHEN len(list_filter({c}, lambda v: {has('v', t)})) > 0 THEN {n} ELSE 0 END" for c, n in (("calls", 9), ("refs", 5))]
        points.append("(" + " + ".join(each) + ")")
    hit = " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in points)
    return f"({base} + {' + '.join(points)} + ({hit})::DOUBLE / {len(points)} * 20) * CASE WHEN module THEN 0.72::DOUBLE ELSE 1.0 END"


_FUNCTIONS = "SELECT 'src/f' || p_partkey || ['.ts', '.java', '.py', '.go', '.rs', '.rb'][p_partkey % 6 + 1] AS path, 'fn' || p_partkey AS symbol, [2, 2, 1, 2, 1, 1][p_partkey % 6 + 1]::INTEGER AS start_line, [4, 4, 2, 4, 3, 3][p_partkey % 6 + 1]::INTEGER AS end_line, CASE WHEN p_partkey = p_partkey % 97 THEN '' ELSE 'fn' || (p_partkey % 97) END AS calls FROM part"
_CHR = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_ADDED_SQL = " || ".join(f"CASE WHEN conv_id % {n} = {k} THEN {_CHR(t)} ELSE '' END" for n, k, t in ADDED)
# which of the added texts a code comes from; of the turns' own texts only the rules for words could match, and are asked
_FOUND = [
    ("BLOCKER", "UNRESOLVED_PLACEHOLDER", "''", r"regexp_matches(body, '(?i)\b(TODO|TBD|FIXME)\b')"), ("BLOCKER", "DOCUMENT_TITLE_CONTRACT", "''", "conv_id % 4 = 0"), ("BLOCKER", "MISSING_SECTIONS", "'user'", "lower(role) <> 'user'"),
    ("WARNING", "WEAK_SECTIONS", "lower(role)", "length(trim(rest, ' ')) < 40"), ("BLOCKER", "MERMAID_UNSAFE", "''", "conv_id % 7 = 0"), ("WARNING", "MERMAID_INVALID", "''", "conv_id % 7 = 0"), ("WARNING", "DIAGRAM_MODE_MISMATCH", "''", "conv_id % 7 = 0 OR conv_id % 5 = 1"),
    ("WARNING", "ASCII_DIAGRAM", "''", "conv_id % 8 = 1"), ("BLOCKER", "PRIVATE_RESOURCE_URI", "''", "conv_id % 10 = 3"), ("WARNING", "RAW_HTML", "''", "conv_id % 11 = 4"),
    ("BLOCKER", "NON_CLIENT_FACING", "array_to_string(told, ', ')", "len(told) > 0"), ("WARNING", "LANGUAGE_REVIEW", "'un po'', perché'", "conv_id % 9 = 2"),
]
_REVIEW = f"""c0 AS (SELECT 'conv/' || conv_id || '/' || turn AS path, coalesce(role, 'x') AS role, conv_id, coalesce(text, '') || {_ADDED_SQL} AS rest FROM conversations),
c AS (SELECT *, '# Title' || chr(10) || chr(10) || '## ' || role || chr(10) || rest AS body, list_filter([CASE WHEN regexp_matches(rest, '(?i)\\bwiki\\b|wiki[_-][a-z_]+|wiki/') THEN 'wiki' END, CASE WHEN regexp_matches(rest, '(?i)\\bagent\\b|\\bLLM\\b|prompt|sub-agent') THEN 'agent' END,
  CASE WHEN regexp_matches(rest, '(?i)\\b(src|tests|docs|wiki)[\\\\/][A-Za-z0-9_./-]+') THEN 'internal path' END], lambda x: x IS NOT NULL) AS told FROM c0),
found AS ({" UNION ALL ".join(f"SELECT path, '{s}' AS severity, '{k}' AS code, {detail} AS detail FROM c WHERE {test}" for s, k, detail, test in _FOUND)})"""
ORACLES = {
    "evidence_buckets": f"WITH {_NOTED} " + " UNION ALL ".join(f"SELECT qid, '{c}' AS category, path FROM noted WHERE {t}" for c, t in _TESTS.items()),
    "impact_edges": f"WITH {_ROLE_EDGES}, ro AS (SELECT 'page:' || path AS root FROM roles WHERE type = 'implementation') SELECT root, 'outgoing' AS direction, kind, dst AS node FROM re JOIN ro ON src = root UNION ALL SELECT root, 'incoming', kind, src FROM re JOIN ro ON dst = root",
    "graph_dependencies": f"WITH {_ROLE_EDGES}, h AS (SELECT doc_id // 20 AS qid, 'doc/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path FROM documents WHERE doc_id % 20 < 4) SELECT DISTINCT b.qid, b.path FROM re JOIN h a ON src = 'page:' || a.path JOIN h b ON dst = 'page:' || b.path AND a.qid = b.qid",
    "code_fragments": _FUNCTIONS, "code_incremental": _FUNCTIONS,
    "code_callers": f"SELECT DISTINCT calls AS target, path FROM ({_FUNCTIONS}) WHERE calls IN ('fn1', 'fn2', 'fn96') AND calls <> symbol",
    "code_search": f"WITH {_PARTS} SELECT path, start_line, symbol, score FROM (SELECT path, start_line, symbol, round({_search_sql('brand steel')}, 6) AS score FROM fr) WHERE score > 0 ORDER BY score DESC, path, start_line LIMIT 25",
    "code_symbol": f"WITH {_PARTS} SELECT path, start_line, symbol, qualified_name, 160 AS score FROM fr WHERE lower(symbol) = 'small_widget' ORDER BY path, start_line LIMIT 25",
    "code_references": f"WITH {_PARTS}, t AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS target FROM part), u AS (SELECT path, start_line, symbol, lower(unnest(calls)) AS n, 0 AS k FROM fr UNION ALL SELECT path, start_line, symbol, lower(unnest(refs)), 1 FROM fr UNION ALL SELECT path, start_line, symbol, lower(imports), 2 FROM fr) SELECT target, ['call', 'reference', 'import'][k + 1] AS how, count(*) AS n FROM (SELECT target, path, start_line, min(k) AS k FROM u JOIN t ON n = lower(target) WHERE lower(symbol) <> lower(target) GROUP BY ALL) GROUP BY ALL",
    "document_review": f"WITH {_REVIEW} SELECT path, severity, code, detail FROM found",
    "document_ready": f"WITH {_REVIEW} SELECT path, coalesce(n, 0) AS blockers, coalesce(n, 0) = 0 AS ready FROM c LEFT JOIN (SELECT path, count(*) AS n FROM found WHERE severity = 'BLOCKER' GROUP BY path) USING (path)",
    "page_lint": f"WITH {corpus.PAGES_SQL} SELECT path, 'ERROR' AS severity, 'INVALID_TYPE' AS code FROM pages_m UNION ALL SELECT path, 'ERROR', 'EMPTY_FILE' FROM pages_m WHERE trim(body, ' ') = ''",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, k""",
}
