"""Queries on a task's gaps and impact, the semantic index, moves of pages and what a migration must not lose."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import functions as F

from ..operators import assets, context, graph, moves, semantic, task
from ..operators.kept import kept, root
from ..sources import corpus
from .context_plans import _NOTED, _ROLE_EDGES, _TESTS, noted_pages
from .graph_plans import linked_pages, role_pages

INTENTS = list(task.REQUIRED)
OLD, NEW = "doc/000000021.md", "moved/page_twenty.md"


def _hits(spark, d):
    """Noted pages of every query: the first eight are shown, every sixth is stale; requests, numbers and sources by id: stated rules."""
    p = noted_pages(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    number = F.when(n % 4 == 0, F.concat(F.lit(" "), (n % 3).cast("string"), F.lit(",5 days"))).when(n % 4 == 1, " 7 days").otherwise("")
    p = p.withColumns({
        "body": F.concat("body", number, F.when(n % 11 == 0, " obsolete").otherwise("")), "request_id": F.when(n % 4 < 3, F.concat(F.lit("Q"), (n % 4).cast("string"))),
        "sources": F.when(n % 17 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")), "shown": F.col("rank") <= 8,
    })
    p = p.withColumn("categories", context.categories(F.col("type"), F.array_join("tags", " "), F.col("body")))
    drift = p.filter(n % 6 == 0).select("path", F.concat(F.lit("c-"), "path").alias("claim_id"), F.when(n % 12 == 0, "anchor_unresolvable").otherwise("drift_suspected").alias("reason"))
    return task.with_drift(task.with_contradictions(p), drift)


def _tasks(spark, d):
    """A task for each query: intents in turn, every third names three pages, every second dropped some evidence."""
    q = noted_pages(spark, d).select("qid").distinct()
    page = lambda k: F.concat(F.lit("doc/"), F.lpad((F.col("qid") * 20 + k).cast("string"), 9, "0"), F.lit(".md"))
    return q.select("qid", F.element_at(F.array(*map(F.lit, INTENTS)), (F.col("qid") % 6 + 1).cast("int")).alias("intent"), F.when(F.col("qid") % 4 == 0, F.array(page(1), page(11), F.lit("gone.md"))).otherwise(F.array().cast("array<string>")).alias("requested"), (F.col("qid") % 2 * 3).alias("omitted"), F.lit(2000).alias("budget"))


def task_buckets(spark, d):
    return task.buckets(_hits(spark, d)).select("qid", "category", "path")


def task_gaps(spark, d):
    q = _tasks(spark, d)
    names = F.element_at(F.array(*map(F.lit, ["source_diversity", "stale_anchor", "contradiction", "truncated"])), (F.col("qid") % 4 + 1).cast("int"))
    coverage = q.select("qid", names.alias("gap"), (F.col("qid") % 3 == 0).alias("limited"))
    return task.gaps(q, kept(_hits(spark, d)), coverage)


def task_impact(spark, d):
    e = graph.role_edges(role_pages(spark, d)).select(F.substring("src", 6, 1 << 30).alias("src"), F.substring("dst", 6, 1 << 30).alias("dst"))
    return task.impact(_tasks(spark, d), kept(_hits(spark, d)), e)


def hashed(texts):
    """Deterministic vectors of 32 dimensions: words counted by a checksum, of length one (all zero for a text without words)."""
    out = []
    for t in texts:
        v = [0.0] * 32
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % 32] += 1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def semantic_sync(spark, d):
    """All pages' passages go in; every tenth page changes, every seventeenth goes, some are taken out: the numbers of the second
    step and what is stored at the end, read back after compaction."""
    p = corpus.pages(spark, d).withColumn("n", F.substring("path", 5, 9).cast("long"))
    index = semantic.SemanticIndex(spark, f"{root(spark)}/semantic", hashed, 32, "hashed-words")
    passages = lambda x: corpus.passages(x).withColumn("heading", F.lit(""))
    index.synchronize(passages(p))
    after = p.filter("n % 17 <> 1").withColumn("body", F.when(F.col("n") % 10 == 0, F.concat("body", F.lit("\nadded line"))).otherwise(F.col("body")))
    n = index.synchronize(passages(after))
    index.remove(after.filter("n % 10 = 3").select("path"))
    index.compact()
    n |= {"stored_pages": index.pages().count(), "stored_passages": index.passages().count()}
    return spark.createDataFrame(list(n.items()), "what string, n long")


def move_changes(spark, d):
    return moves.link_changes(linked_pages(spark, d), OLD, NEW)


def move_applied(spark, d):
    """All pages after a move."""
    return moves.moved(linked_pages(spark, d), OLD, NEW).select("path", "body")


def page_warnings(spark, d):
    """Every page as written anew, three to a title."""
    n = F.substring("path", 5, 9).cast("long")
    p = linked_pages(spark, d).withColumn("title", F.concat(F.lit("Document "), (n - n % 3).cast("string")))
    return moves.content_warnings(p, p)


def migration_regressions(spark, d):
    """A migration that loses every page that ends in 25, and finds again two of three: a stated rule."""
    p = role_pages(spark, d).withColumn("sources", F.array("type"))
    n = F.substring("path", 5, 9).cast("long")

    def side(pages, found):
        edges = graph.role_edges(pages)
        return {"pages": pages, "probes": pages.select("path", found.alias("recovered")), "edges": edges}

    return moves.regressions(side(p, n % 2 == 0), side(p.filter(n % 100 != 25), n % 3 > 0))


#: An image's address, and what its check finds (severity, code), with the assets below.
IMAGES = [
    ("https://x.org/a.png", "WARNING", "ASSET_REMOTE"), ("JavaScript:x", "BLOCKER", "ASSET_UNSAFE_URI"), ("java&#115;cript:x", "BLOCKER", "ASSET_UNSAFE_URI"), ("ftp://x/a.png", "WARNING", "ASSET_NON_PORTABLE"),
    ("..\\\\assets\\\\a.png", "BLOCKER", "ASSET_PATH_INVALID"), ("../assets/%zz.png", "BLOCKER", "ASSET_PATH_INVALID"), ("a.png", "BLOCKER", "ASSET_PATH_INVALID"), ("../assets/../b.png", "BLOCKER", "ASSET_PATH_ESCAPE"),
    ("../assets/none.png", "BLOCKER", "ASSET_MISSING"), ("../assets/big.png", "BLOCKER", "ASSET_TOO_LARGE"), ("../assets/bad.png", "BLOCKER", "ASSET_SIGNATURE_INVALID"), ("../assets/bad.svg", "BLOCKER", "ASSET_SIGNATURE_INVALID"),
    ("../assets/run.svg", "BLOCKER", "SVG_ACTIVE_CONTENT"), ("../assets/far.svg", "BLOCKER", "SVG_ACTIVE_CONTENT"), ("../assets/a.jpg", "WARNING", "ASSET_TYPE_UNSUPPORTED"), ("../assets/good%20one.png?x", None, None), ("../assets/fine.svg", None, None),
]
ASSETS = [
    ("big.png", 6 << 20, "", None), ("bad.png", 10, "00", None), ("bad.svg", 10, "00", "<p><svg>"), ("run.svg", 10, "00", "<?xml version='1'?>\n<svg onload = 'x'>"), ("far.svg", 10, "00", "<svg><a href='h&#116;tp://x'/></svg>"), ("a.jpg", 10, "00", None),
    ("good one.png", 10, assets.PNG, None), ("fine.svg", 10, "00", "<svg><a href='#b'/></svg>"), ("b.png", 10, assets.PNG, None),
]


def asset_checks(spark, d):
    """Every turn of the conversations with an image by its number; stated rules."""
    c = corpus.table(spark, d, "conversations")
    image = F.element_at(F.array(*(F.lit(x[0]) for x in IMAGES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(IMAGES) + 1).cast("int"))
    docs = c.select(F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n![i]("), image, F.lit(")")).alias("body"))
    return assets.findings(docs, spark.createDataFrame(ASSETS, "asset string, size long, head string, text string"))


QUERIES = {f.__name__: f for f in (task_buckets, task_gaps, task_impact, semantic_sync, move_changes, move_applied, page_warnings, migration_regressions, asset_checks)}

_QUOTED = lambda x: "NULL" if x is None else "'" + x + "'"
_WORD = "(?i)(^|[^a-z0-9_])(stale|obsolete|outdated|legacy_unverified)($|[^a-z0-9_])"
_HITS = f"""{_NOTED}, h0 AS (SELECT qid, path, rank, type, tags, n, CASE WHEN n % 4 < 3 THEN n % 4 END AS req, body || CASE n % 4 WHEN 0 THEN ' ' || (n % 3) || ',5 days' WHEN 1 THEN ' 7 days' ELSE '' END || CASE WHEN n % 11 = 0 THEN ' obsolete' ELSE '' END AS body,
  rank <= 8 AS shown, n % 6 = 0 AS stale, CASE WHEN n % 12 = 0 THEN 'anchor_unresolvable' WHEN n % 6 = 0 THEN 'drift_suspected' END AS reason FROM (SELECT *, substr(path, 5, 9)::BIGINT AS n FROM noted)),
own AS ({' UNION ALL '.join(f"SELECT qid, path, '{c}' AS category FROM h0 WHERE {t}" for c, t in _TESTS.items())}),
grp AS (SELECT qid, req FROM h0 WHERE req IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND (bool_or((qid, path) IN (SELECT (qid, path) FROM own WHERE category = 'contradictions')) OR count(DISTINCT CASE WHEN n % 4 = 0 THEN (n % 3) || '.5' WHEN n % 4 = 1 THEN '7' END) >= 2)),
cat AS (SELECT qid, path, category FROM own UNION SELECT h0.qid, path, 'contradictions' FROM h0 JOIN grp USING (qid, req)),
hc AS (SELECT h0.*, category FROM h0 JOIN cat USING (qid, path)),
tasks AS (SELECT DISTINCT qid, {INTENTS!r}[qid % 6 + 1] AS intent, CASE WHEN qid % 4 = 0 THEN ['doc/' || lpad((qid * 20 + 1)::VARCHAR, 9, '0') || '.md', 'doc/' || lpad((qid * 20 + 11)::VARCHAR, 9, '0') || '.md', 'gone.md'] ELSE [] END AS requested, qid % 2 * 3 AS omitted FROM h0)"""
_NEED = "need AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{c}', '{task.LABELS[c]}')" for i, cs in task.REQUIRED.items() for c in cs) + ") v(intent, category, label))"
_GAP = {
    "omit": "' was retrieved but omitted by the display budget for intent '", "stale": "' is covered only by stale evidence that requires re-verification for intent '",
}
ORACLES = {
    "task_buckets": f"WITH {_HITS} SELECT qid, category, path FROM hc WHERE shown AND NOT stale",
    "task_gaps": f"""WITH {_HITS}, {_NEED}, c AS (SELECT qid, category, bool_or(shown AND NOT stale) AS here, bool_or(NOT stale) AS beyond, bool_or(shown AND stale) AS stale_here, bool_or(reason = 'anchor_unresolvable') AS lost, string_agg(path, ', ' ORDER BY path) FILTER (stale) AS paths FROM hc GROUP BY ALL),
nd AS (SELECT * FROM tasks JOIN need USING (intent) LEFT JOIN c USING (qid, category) WHERE NOT coalesce(here, false)),
cov AS (SELECT qid, ['source_diversity', 'stale_anchor', 'contradiction', 'truncated'][qid % 4 + 1] AS gap FROM tasks),
asked AS (SELECT t.qid, t.p, h0.shown FROM (SELECT qid, unnest(requested) AS p FROM tasks) t LEFT JOIN h0 ON h0.qid = t.qid AND h0.path = t.p WHERE NOT coalesce(h0.shown, false))
SELECT qid, ['missing_evidence', 'stale_evidence', 'contradiction', 'budget_limited'][qid % 4 + 1] AS kind, NULL AS reason, 'Hybrid coverage gap: ' || gap || '.' AS description FROM cov WHERE qid % 3 <> 0
UNION SELECT qid, 'budget_limited', NULL, 'Hybrid coverage evidence was retrieved but omitted by the display budget: ' || gap || '.' FROM cov WHERE qid % 3 = 0
UNION SELECT qid, 'budget_limited', NULL, label || {_GAP['omit']} || intent || '.' FROM nd WHERE beyond
UNION SELECT qid, 'stale_evidence', CASE WHEN lost THEN 'anchor_unresolvable' ELSE 'drift_suspected' END, label || {_GAP['stale']} || intent || ': ' || paths || '.' FROM nd WHERE NOT beyond AND paths IS NOT NULL AND NOT stale_here
UNION SELECT qid, 'missing_evidence', NULL, 'No ' || label || ' was recovered for intent ' || intent || '.' FROM nd WHERE NOT coalesce(beyond, false) AND paths IS NULL
UNION SELECT qid, CASE WHEN shown IS NULL THEN 'missing_evidence' ELSE 'budget_limited' END, NULL, 'Requested changed component was ' || CASE WHEN shown IS NULL THEN 'not recovered by the bounded hybrid path: ' ELSE 'retrieved but omitted by the display budget: ' END || p || '.' FROM asked
UNION SELECT qid, 'stale_evidence', NULL, 'Potentially stale evidence requires validation: ' || string_agg(path, ', ' ORDER BY path) || '.' FROM h0 WHERE shown AND regexp_matches(tags || ' ' || body, '{_WORD}') GROUP BY qid
UNION SELECT qid, 'stale_evidence', reason, CASE reason WHEN 'drift_suspected' THEN 'Code-backed evidence changed' ELSE 'Code-backed evidence could not be resolved safely' END || ' and requires re-verification: ' || string_agg(path, ', ' ORDER BY path) || '.' FROM h0 WHERE shown AND stale GROUP BY qid, reason
UNION SELECT qid, 'contradiction', NULL, 'Conflicting evidence requires resolution: ' || string_agg(path, ', ' ORDER BY rank) || '.' FROM hc WHERE shown AND NOT stale AND category = 'contradictions' GROUP BY qid
UNION SELECT qid, CASE WHEN s IS NULL THEN 'missing_evidence' ELSE 'budget_limited' END, NULL, CASE WHEN s IS NULL THEN 'No source provenance was recovered for the document task.' ELSE 'Source provenance was retrieved but omitted by the display budget for the document task.' END FROM tasks LEFT JOIN (SELECT qid, bool_or(shown) AS s FROM h0 WHERE n % 17 = 0 GROUP BY qid) USING (qid) WHERE intent = 'document' AND NOT coalesce(s, false)
UNION SELECT qid, 'budget_limited', NULL, omitted || ' evidence item(s) omitted to respect the 2000-token heuristic task-context budget.' FROM tasks WHERE omitted > 0""",
    "task_impact": f"""WITH {_ROLE_EDGES}, {_HITS[_HITS.index('noted AS'):]},
s AS (SELECT * FROM h0 WHERE shown), inf AS (SELECT qid, arg_min(path, (CASE WHEN (qid, path) IN (SELECT (qid, path) FROM cat WHERE category = 'affectedComponents') THEN 0 ELSE 100 END) + rank) AS path FROM s JOIN tasks USING (qid) WHERE len(requested) = 0 AND intent IN ('implement', 'modify', 'debug', 'review') GROUP BY qid),
ro AS (SELECT qid, path FROM (SELECT qid, unnest(requested) AS path FROM tasks) SEMI JOIN s USING (qid, path) UNION SELECT qid, path FROM inf),
am AS (SELECT DISTINCT a.qid, a.path AS src, b.path AS dst FROM re JOIN s a ON re.src = 'page:' || a.path JOIN s b ON re.dst = 'page:' || b.path AND a.qid = b.qid WHERE a.path <> b.path),
i AS (SELECT am.qid, src AS path FROM am JOIN ro ON am.qid = ro.qid AND dst = ro.path), o AS (SELECT am.qid, dst AS path FROM am JOIN ro ON am.qid = ro.qid AND src = ro.path),
rel AS (SELECT * FROM ro UNION SELECT * FROM i UNION SELECT * FROM o UNION SELECT s.qid, s.path FROM s JOIN (SELECT qid, req FROM s SEMI JOIN ro USING (qid, path) WHERE req IS NOT NULL) USING (qid, req))
SELECT qid, 'changedComponents' AS part, path FROM ro UNION SELECT qid, 'incomingDependencies', path FROM i UNION SELECT qid, 'outgoingDependencies', path FROM o
UNION SELECT qid, category, path FROM hc SEMI JOIN rel USING (qid, path) WHERE shown AND NOT stale AND category IN {tuple(task.IMPACT_PARTS)!r}""",
    "semantic_sync": f"""WITH {corpus.PAGES_SQL}, l AS (SELECT doc_id AS n, len(list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ') <> '')) AS k FROM pages_m),
a AS (SELECT n, k, CASE WHEN n % 10 = 0 THEN k + 1 ELSE k END AS k2 FROM l)
SELECT 'embedded' AS what, count(*) AS n FROM a WHERE n % 17 <> 1 AND n % 10 = 0 UNION ALL SELECT 'removed', count(*) FROM a WHERE n % 17 = 1 AND k > 0 UNION ALL SELECT 'reused', count(*) FROM a WHERE n % 17 <> 1 AND n % 10 <> 0 AND k > 0
UNION ALL SELECT 'passages', sum(k2)::BIGINT FROM a WHERE n % 17 <> 1 AND n % 10 = 0 UNION ALL SELECT 'stored_pages', count(*) FROM a WHERE n % 17 <> 1 AND n % 10 <> 3 AND k2 > 0 UNION ALL SELECT 'stored_passages', sum(k2)::BIGINT FROM a WHERE n % 17 <> 1 AND n % 10 <> 3""",
}
_MOVE = f"""{corpus.PAGES_SQL}, k AS (SELECT path, doc_id AS n, lpad((doc_id * 7 % 150)::VARCHAR, 9, '0') || '.md' AS x, lpad((doc_id * 3 % 40)::VARCHAR, 9, '0') || '.md' AS z, lpad((doc_id * 5 % 60)::VARCHAR, 9, '0') || '.md' AS u, lpad((doc_id * 11 % 90)::VARCHAR, 9, '0') AS w FROM pages_m)"""
_AT = "'](../moved/page_twenty.md)'"
ORACLES |= {
    "move_changes": f"""WITH {_MOVE} SELECT path, 'wikilink' AS type, '[[' || w || ']]' AS old_ref, '[[page twenty]]' AS new_ref FROM k WHERE n <> 21 AND w = '000000021'
UNION ALL SELECT path, 'mdlink', '](' || x || ')', {_AT} FROM k WHERE n <> 21 AND x = '000000021.md' UNION ALL SELECT path, 'mdlink', '](../doc/./' || z || ')', {_AT} FROM k WHERE n <> 21 AND z = '000000021.md'
UNION ALL SELECT path, 'mdlink', '](' || x || ')', '](../doc/' || x || ')' FROM k WHERE n = 21 UNION ALL SELECT path, 'mdlink', '](../doc/./' || z || ')', '](../doc/' || z || ')' FROM k WHERE n = 21
UNION ALL SELECT path, 'mdlink', '](doc/' || u || ')', '](../doc/doc/' || u || ')' FROM k WHERE n = 21""",
    "move_applied": f"""WITH {_MOVE} SELECT CASE WHEN n = 21 THEN '{NEW}' ELSE path END AS path, CASE WHEN n % 2 = 0 THEN '[[Document ' || (n + 1) || ']]' ELSE '' END || ' [x' || CASE WHEN n = 21 THEN '](../doc/' || x || ')' WHEN x = '000000021.md' THEN {_AT} ELSE '](' || x || ')' END
|| ' [[Missing ' || (n % 7) || ']] [y](https://example.com) [z' || CASE WHEN n = 21 THEN '](../doc/' || z || ')' WHEN z = '000000021.md' THEN {_AT} ELSE '](../doc/./' || z || ')' END || ' [u](' || CASE WHEN n = 21 THEN '../doc/' ELSE '' END || 'doc/' || u || ') [[' || CASE WHEN n <> 21 AND w = '000000021' THEN 'page twenty' ELSE w END || ']]' AS body FROM k""",
    "page_warnings": f"""WITH {_MOVE} SELECT path, 'UNRESOLVED_NAME' AS code, 'Missing ' || (n % 7) AS detail FROM k UNION ALL SELECT path, 'UNRESOLVED_NAME', 'Document ' || (n + 1) FROM k WHERE n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.n - b.n % 3 = k.n + 1)
UNION ALL SELECT path, 'UNRESOLVED_NAME', w FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.path = 'doc/' || k.w || '.md') UNION ALL SELECT a.path, 'DUPLICATE_TITLE', string_agg(b.path, ', ' ORDER BY b.path) FROM k a JOIN k b ON a.n - a.n % 3 = b.n - b.n % 3 AND a.n <> b.n GROUP BY a.path""",
    "migration_regressions": f"""WITH {_ROLE_EDGES}, r2 AS (SELECT * FROM roles WHERE substr(path, 5, 9)::BIGINT % 100 <> 25), e2 AS (SELECT * FROM re WHERE substr(src, 6) IN (SELECT path FROM r2) AND substr(dst, 6) IN (SELECT path FROM r2)),
a AS (SELECT 'pages' AS what, '' AS key, count(*) AS n FROM roles UNION ALL SELECT 'sources', '', count(DISTINCT type) FROM roles UNION ALL SELECT 'edges', kind, count(*) FROM re GROUP BY kind),
b AS (SELECT 'pages' AS what, '' AS key, count(*) AS n FROM r2 UNION ALL SELECT 'sources', '', count(DISTINCT type) FROM r2 UNION ALL SELECT 'edges', kind, count(*) FROM e2 GROUP BY kind)
SELECT what, key FROM a FULL JOIN b USING (what, key) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) UNION ALL SELECT 'probe', path FROM roles WHERE substr(path, 5, 9)::BIGINT % 2 = 0 AND path NOT IN (SELECT path FROM r2 WHERE substr(path, 5, 9)::BIGINT % 3 > 0)""",
}
ORACLES["asset_checks"] = f"WITH v AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_QUOTED(t)}, {_QUOTED(a)}, {_QUOTED(b)})' for k, (t, a, b) in enumerate(IMAGES))}) x(k, target, severity, code)) SELECT 'conv/' || conv_id || '/' || turn AS path, severity, code, target FROM conversations JOIN v ON k = (conv_id * 7 + turn) % {len(IMAGES)} WHERE code IS NOT NULL"
