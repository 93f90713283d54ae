"""Queries on the property graph, links and lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, graph
from ..sources import corpus

#: Five pages of a request, one of each role: a stated rule on the ids.
ROLE_TYPES = ["request", "requirement", "implementation", "test_result", "release"]


def page_roles(n):
    """Title, type and request of the document of an id: pages of requests of 20, their types dealt by id."""
    return {"title": F.concat(F.lit("Document "), n.cast("string")), "type": F.element_at(F.array(*map(F.lit, ROLE_TYPES)), (n % 5 + 1).cast("int")), "request_id": F.concat(F.lit("R-"), F.floor(n / 20).cast("string"))}


def role_pages(spark, d):
    """Documents as pages with their roles."""
    t = corpus.table(spark, d, "documents")
    return t.select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), *(c.alias(name) for name, c in page_roles(F.col("doc_id")).items()))


def linked_pages(spark, d):
    """Pages whose bodies link by title (even ids), by file name, by paths from their own folder, over another folder and to what
    doesn't exist: a stated rule."""
    p = corpus.pages(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    file = lambda k, m: F.lpad((n * k % m).cast("string"), 9, "0")
    body = F.concat(
        F.when(n % 2 == 0, F.concat(F.lit("[[Document "), (n + 1).cast("string"), F.lit("]]"))).otherwise(F.lit("")), F.lit(" [x]("), file(7, 150), F.lit(".md) [[Missing "), (n % 7).cast("string"), F.lit("]] [y](https://example.com) [z](../doc/./"),
        file(3, 40), F.lit(".md) [u](doc/"), file(5, 60), F.lit(".md) [["), file(11, 90), F.lit("]]"),
    )
    return p.withColumn("body", body)


def link_candidates(spark, d):
    """All pages that the bodies' names can mean; the titles are shared by the pages of a thousand, a stated rule."""
    p = corpus.pages(spark, d).withColumn("title", F.concat(F.lit("Title "), (F.substring("path", 5, 9).cast("long") % 1000).cast("string")))
    names = p.select(F.explode(F.array(F.col("title"), F.upper("title"), F.substring("path", 1, 13), F.substring("path", 5, 9))).alias("name"))
    return graph.link_matches(p, names)


def graph_nodes(spark, d):
    return graph.nodes(corpus.pages(spark, d))


def graph_edges(spark, d):
    return graph.metadata_edges(corpus.pages(spark, d))


def graph_degree(spark, d):
    return graph.degrees(graph.metadata_edges(corpus.pages(spark, d)))


def graph_kind_counts(spark, d):
    p = corpus.pages(spark, d)
    a = graph.nodes(p).groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    b = graph.metadata_edges(p).groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return a.unionByName(b)


def same_request_roles(spark, d):
    return graph.role_edges(role_pages(spark, d))


def traceability(spark, d):
    return governance.traceability(role_pages(spark, d).filter("length(title) % 3 > 0 OR type <> 'release'"))


def link_targets(spark, d):
    return graph.resolved_links(linked_pages(spark, d))


def unresolved_links(spark, d):
    return graph.resolved_links(linked_pages(spark, d)).filter("resolved IS NULL").select("path", "target")


def orphans(spark, d):
    return governance.orphans(linked_pages(spark, d))


def duplicate_titles(spark, d):
    p = corpus.pages(spark, d).withColumn("title", F.split("body", "\n")[0])
    return governance.duplicate_titles(p)


def trade_edges(spark, d):
    """Orders to customers, customers and suppliers to nations: a larger graph without request nodes."""
    t = lambda n: corpus.table(spark, d, n)
    node = lambda k, c: F.concat(F.lit(k + ":"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return (
        t("orders").select(node("order", "o_orderkey").alias("src"), F.lit("links_to").alias("kind"), node("customer", "o_custkey").alias("dst"))
        .unionByName(t("customer").select(node("customer", "c_custkey").alias("src"), F.lit("derived_from").alias("kind"), node("nation", "c_nationkey").alias("dst")))
        .unionByName(t("supplier").select(node("supplier", "s_suppkey").alias("src"), F.lit("derived_from").alias("kind"), node("nation", "s_nationkey").alias("dst")))
    )


def _expansion(depth):
    def run(spark, d):
        e = trade_edges(spark, d)
        ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        kinds = ends.select("node", F.split("node", ":")[0].alias("kind"))
        seeds = corpus.table(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("customer:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("node"), F.lit(1.0).alias("score"))
        return graph.expand(e, kinds, seeds, max_nodes=12, depth=depth, beam=8, max_visited=32).select("qid", "node", F.round("value", 6).alias("value"), "place")

    return run


def expand_request(spark, d):
    p = role_pages(spark, d).withColumn("tags", F.array("type")).withColumn("sources", F.array(F.lit("s")))
    e = graph.metadata_edges(p).unionByName(graph.role_edges(p))
    kinds = graph.nodes(p).select(F.col("id").alias("node"), "kind")
    seeds = p.filter("substring(path, 5, 9) % 50 = 0").select(F.substring("path", 5, 9).cast("long").alias("qid"), F.concat(F.lit("page:"), F.col("path")).alias("node"), F.lit(1.0).alias("score"))
    return graph.expand_exact(e, kinds, seeds, depth=1)


def induced_edges(spark, d):
    e = trade_edges(spark, d)
    chosen = corpus.table(spark, d, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("customer:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("node"))
    chosen = chosen.unionByName(corpus.table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("nation:"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("node")))
    return graph.induced(e, chosen).select("src", "kind", "dst")


QUERIES = {
    "graph_nodes": graph_nodes, "graph_edges": graph_edges, "graph_degree": graph_degree, "graph_kind_counts": graph_kind_counts, "same_request_roles": same_request_roles,
    "traceability": traceability, "link_targets": link_targets, "unresolved_links": unresolved_links, "link_candidates": link_candidates, "orphans": orphans, "duplicate_titles": duplicate_titles,
    "expand_1hop": _expansion(1), "expand_khop": _expansion(2), "expand_request": expand_request, "induced_edges": induced_edges,
}

_SLUG = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item')"
_EDGES = f"""{corpus.PAGES_SQL},
edges AS (SELECT DISTINCT 'page:' || path AS src, 'derived_from' AS kind, 'source:' || {_SLUG('v')} AS dst FROM (SELECT path, unnest(sources) AS v FROM pages_m)
  UNION SELECT 'page:' || path, 'has_tag', 'tag:' || {_SLUG('v')} FROM (SELECT path, unnest(tags) AS v FROM pages_m)
  UNION SELECT 'page:' || path, 'same_request', 'request:' || {_SLUG('request_id')} FROM pages_m),
nodes AS (SELECT 'page:' || path AS id, 'page' AS kind, title AS label FROM pages_m
  UNION SELECT 'source:' || {_SLUG('v')}, 'source', min(v) FROM (SELECT unnest(sources) AS v FROM pages_m) GROUP BY 1
  UNION SELECT 'tag:' || {_SLUG('v')}, 'tag', min(v) FROM (SELECT unnest(tags) AS v FROM pages_m) GROUP BY 1
  UNION SELECT 'request:' || {_SLUG('request_id')}, 'request', min(request_id) FROM pages_m GROUP BY 1)"""
_ROLES = f"""roles AS (SELECT 'doc/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, 'Document ' || doc_id AS title, {ROLE_TYPES!r}[doc_id % 5 + 1] AS type, 'R-' || (doc_id // 20) AS request_id FROM documents)"""
_LINKED = f"""{corpus.PAGES_SQL}, linked AS (SELECT path, title, doc_id AS n FROM pages_m),
links AS (SELECT path, 'Document ' || (n + 1) AS target, 'doc/' || lpad((n + 1)::VARCHAR, 9, '0') || '.md' AS goal FROM linked WHERE n % 2 = 0
  UNION SELECT path, lpad((n * 7 % 150)::VARCHAR, 9, '0') || '.md', 'doc/' || lpad((n * 7 % 150)::VARCHAR, 9, '0') || '.md' FROM linked
  UNION SELECT path, '../doc/./' || lpad((n * 3 % 40)::VARCHAR, 9, '0') || '.md', 'doc/' || lpad((n * 3 % 40)::VARCHAR, 9, '0') || '.md' FROM linked
  UNION SELECT path, 'doc/' || lpad((n * 5 % 60)::VARCHAR, 9, '0') || '.md', NULL FROM linked
  UNION SELECT path, lpad((n * 11 % 90)::VARCHAR, 9, '0'), 'doc/' || lpad((n * 11 % 90)::VARCHAR, 9, '0') || '.md' FROM linked
  UNION SELECT path, 'Missing ' || (n % 7), NULL FROM linked),
resolved AS (SELECT l.path, target, p.path AS resolved FROM links l LEFT JOIN linked p ON l.goal = p.path)"""
_TRADE = """edges AS (SELECT 'order:' || lpad(o_orderkey::VARCHAR, 9, '0') AS src, 'links_to' AS kind, 'customer:' || lpad(o_custkey::VARCHAR, 9, '0') AS dst, 0.7 AS weight FROM orders
  UNION ALL SELECT 'customer:' || lpad(c_custkey::VARCHAR, 9, '0'), 'derived_from', 'nation:' || lpad(c_nationkey::VARCHAR, 9, '0'), 0.55 FROM customer
  UNION ALL SELECT 'supplier:' || lpad(s_suppkey::VARCHAR, 9, '0'), 'derived_from', 'nation:' || lpad(s_nationkey::VARCHAR, 9, '0'), 0.55 FROM supplier)"""


def _expand_sql(depth):
    parts = [_TRADE, "both_m AS (SELECT src AS node, dst AS neighbor, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)", "deg AS (SELECT node, count(*) AS degree FROM both_m GROUP BY node)",
             "near AS (SELECT b.node, neighbor, max(weight)::DOUBLE * 0.6::DOUBLE / log2(2 + any_value(degree)) AS factor FROM both_m b JOIN deg d ON b.neighbor = d.node GROUP BY b.node, neighbor)",
             "f0 AS (SELECT c_custkey AS qid, 'customer:' || lpad(c_custkey::VARCHAR, 9, '0') AS node, 1.0::DOUBLE AS value FROM customer WHERE c_custkey % 50 = 0)"]
    for h in range(depth + 1):
        used = "" if h == 0 else f" LEFT JOIN (SELECT qid, count(*) AS used FROM ({' UNION ALL '.join(f'SELECT * FROM c{i}' for i in range(h))}) GROUP BY qid) u USING (qid)"
        parts.append(f"c{h} AS (SELECT qid, node, value FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, node) AS rn FROM f{h}){used} WHERE rn <= 8 AND rn + {'0' if h == 0 else 'coalesce(used, 0)'} <= 32)")
        if h < depth:
            seen = " UNION ALL ".join(f"SELECT qid, node FROM f{i}" for i in range(h + 1))
            parts.append(f"f{h + 1} AS (SELECT qid, neighbor AS node, max(value * factor) AS value FROM c{h} JOIN near USING (node) WHERE (qid, neighbor) NOT IN (SELECT (qid, node) FROM ({seen})) GROUP BY qid, neighbor)")
    every = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(depth + 1))
    return "WITH " + ",\n".join(parts) + f" SELECT qid, node, round(value, 6) AS value, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, node) AS place FROM ({every})) WHERE place <= 12"


ORACLES = {
    "graph_nodes": f"WITH {_EDGES} SELECT id, kind, label FROM nodes",
    "graph_edges": f"WITH {_EDGES} SELECT src, kind, dst FROM edges",
    "graph_degree": f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node",
    "graph_kind_counts": f"WITH {_EDGES} SELECT kind, count(*) AS n, 'node' AS what FROM nodes GROUP BY kind UNION ALL SELECT kind, count(*), 'edge' FROM edges GROUP BY kind",
    "same_request_roles": f"""WITH {_ROLES} SELECT 'page:' || a.path AS src, CASE WHEN b.type = 'implementation' THEN 'implements' WHEN b.type = 'test_result' THEN 'tests' ELSE 'released_by' END AS kind, 'page:' || b.path AS dst
FROM roles a JOIN roles b USING (request_id) WHERE (a.type IN ('request', 'requirement') AND b.type = 'implementation') OR (a.type IN ('requirement', 'implementation') AND b.type = 'test_result') OR (a.type IN ('request', 'implementation') AND b.type = 'release')""",
    "traceability": f"""WITH {_ROLES}, r AS (SELECT * FROM roles WHERE length(title) % 3 > 0 OR type <> 'release'), g AS (SELECT request_id, list(DISTINCT type) AS have FROM r GROUP BY request_id)
SELECT request_id, array_to_string(list_filter(['request', 'requirement', 'implementation', 'test_result', 'release'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""",
    "link_targets": f"WITH {_LINKED} SELECT path, target, resolved FROM resolved",
    "link_candidates": f"WITH {corpus.PAGES_SQL}, t AS (SELECT path, 'Title ' || doc_id % 1000 AS title, doc_id FROM pages_m), n AS (SELECT title AS name FROM t UNION SELECT upper(title) FROM t UNION SELECT substr(path, 1, 13) FROM t UNION SELECT substr(path, 5, 9) FROM t) SELECT DISTINCT name, path FROM n JOIN t ON lower(name) = lower(title) OR name || '.md' = path OR 'doc/' || name || '.md' = path",
    "unresolved_links": f"WITH {_LINKED} SELECT path, target FROM resolved WHERE resolved IS NULL",
    "orphans": f"WITH {_LINKED} SELECT path FROM linked WHERE path NOT IN (SELECT resolved FROM resolved WHERE resolved IS NOT NULL AND resolved <> path)",
    "duplicate_titles": f"WITH {corpus.PAGES_SQL} SELECT lower(trim(string_split(body, chr(10))[1], ' ')) AS title, count(*) AS n, min(path) AS first_path FROM pages_m GROUP BY 1 HAVING count(*) > 1",
    "expand_1hop": _expand_sql(1), "expand_khop": _expand_sql(2),
    "induced_edges": f"""WITH {_TRADE}, chosen AS (SELECT 'customer:' || lpad(c_custkey::VARCHAR, 9, '0') AS node FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'nation:' || lpad(n_nationkey::VARCHAR, 9, '0') FROM nation WHERE n_regionkey = 1)
SELECT src, kind, dst FROM edges WHERE src IN (SELECT node FROM chosen) AND dst IN (SELECT node FROM chosen)""",
}
