"""Queries on inventories, percentiles, assessments and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, evidence, inventory
from ..sources import corpus
from . import evidence_plans as ev
from .graph_plans import _ROLES, role_pages


def inventory_by_type(spark, d):
    return inventory.by_type(corpus.pages(spark, d))


def page_catalogue(spark, d):
    return inventory.catalogue(role_pages(spark, d))


def source_pages(spark, d):
    return inventory.pages_of_sources(corpus.pages(spark, d))


def source_coverage(spark, d):
    """Sources of even number are covered by ten times their number, at most 100; odd ones have no ledger; a stated rule."""
    p = corpus.pages(spark, d)
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    s = p.select(F.explode("sources").alias("source")).distinct().filter(n % 2 == 0).withColumn("percent", F.least(F.lit(100), n * 10).cast("double"))
    return inventory.source_coverage(p, s)


def value_percentiles(spark, d):
    return inventory.percentiles(corpus.table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


def path_prefix(spark, d):
    c = corpus.table(spark, d, "conversations").select(F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"))
    return c.filter(inventory.under(F.col("path"), "conv/1"))


def migration_assessment(spark, d):
    f = corpus.pages(spark, d).select("path", F.col("body").alias("raw"))
    n = F.substring("path", 5, 9).cast("long") % 5
    new = f.filter(n != 1).withColumn("raw", F.when(n == 2, F.regexp_replace("raw", "\n", "\r\n")).when(n == 3, F.concat("raw", F.lit("+"))).otherwise(F.col("raw")))
    return inventory.assessment(f.filter(n != 0), new)


def synthesis_plan(spark, d):
    c = ev.claims(spark, d)
    return inventory.synthesis_plan(c, ev.claim_resolution(spark, d), F.col("anchor"))


def recovery_closed(spark, d):
    e = ev.recovery_events(spark, d)
    c = e.filter("occurrences % 2 = 0").select("recovery_id", F.col("last_seen").alias("ts"))
    return inventory.closed(e, c.unionByName(c)).select("recovery_id", "status")


def most_drifted(spark, d):
    cited = corpus.table(spark, d, "events").select((F.col("user_id") % 60).alias("anchor_id"))
    return inventory.most_drifted(ev.drift_verdicts(spark, d), cited)


def fallback_demand(spark, d):
    e = corpus.table(spark, d, "events").select(F.create_map(F.concat(F.lit("."), F.col("event_type")), F.get_json_object("props", "$.k").cast("long")).alias("extension_histogram"))
    return code.fallback_demand(e)


def case_collisions(spark, d):
    m = corpus.table(spark, d, "documents").select(F.explode(F.split("text", "[ \n]")).alias("path"))
    return evidence.collisions(m)


QUERIES = {f.__name__: f for f in (inventory_by_type, page_catalogue, source_pages, source_coverage, value_percentiles, path_prefix, migration_assessment, synthesis_plan, recovery_closed, most_drifted, fallback_demand, case_collisions)}
ORACLES = {
    "inventory_by_type": "SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang",
    "page_catalogue": f"WITH {_ROLES}, t AS (SELECT *, CASE type WHEN 'request' THEN 10 WHEN 'requirement' THEN 11 WHEN 'implementation' THEN 12 WHEN 'test_result' THEN 13 ELSE 15 END AS type_order FROM roles) SELECT type_order, type, row_number() OVER (PARTITION BY type ORDER BY title, path)::INTEGER AS place, title, path FROM t",
    "source_pages": f"WITH {corpus.PAGES_SQL} SELECT source, count(DISTINCT path) AS pages, min(path) AS first_path FROM (SELECT path, unnest(sources) AS source FROM pages_m) GROUP BY source",
    "source_coverage": f"WITH {corpus.PAGES_SQL} SELECT path, round(CASE WHEN n % 2 = 0 THEN least(100, n * 10)::DOUBLE ELSE 0.0 END, 4) AS coverage FROM (SELECT path, regexp_extract(sources[1], '([0-9]+)$', 1)::INTEGER AS n FROM pages_m)",
    "value_percentiles": "WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(l_quantity) FILTER (rn = ceil(0.5 * n)) AS p50, max(l_quantity) FILTER (rn = ceil(0.95 * n)) AS p95, max(l_quantity) FILTER (rn = ceil(0.99 * n)) AS p99 FROM r GROUP BY l_returnflag",
    "path_prefix": "SELECT 'conv/' || conv_id || '/' || turn AS path FROM conversations WHERE conv_id = 1",
    "migration_assessment": f"WITH {corpus.PAGES_SQL} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'missing' WHEN 2 THEN CASE WHEN contains(body, chr(10)) THEN 'line_endings' ELSE 'exact' END WHEN 3 THEN 'changed' ELSE 'exact' END AS state FROM pages_m",
    "synthesis_plan": f"WITH {ev._CLAIMS} SELECT anchor AS page, count(*) AS claims, string_agg('- ' || text || ' (' || claim_id || ')', chr(10) ORDER BY claim_id) AS block FROM claims JOIN res USING (claim_id) WHERE disposition IN ('candidate_update', 'candidate_new_page', 'supersedes') GROUP BY anchor",
    "recovery_closed": f"WITH {ev._RECOVERY} SELECT recovery_id, CASE WHEN occurrences % 2 = 0 THEN 'resolved' ELSE status END AS status FROM rec",
    "most_drifted": f"WITH {ev._DRIFT}, c AS (SELECT user_id % 60 AS anchor_id, count(*) AS n FROM events GROUP BY 1) SELECT anchor_id, path, reason, coalesce(n, 0) AS citations FROM drift LEFT JOIN c USING (anchor_id) WHERE verdict = 'drift_suspected' ORDER BY citations DESC, path LIMIT 20",
    "fallback_demand": "SELECT '.' || event_type AS extension, sum((props->>'$.k')::BIGINT)::BIGINT AS searches FROM events GROUP BY 1",
    "case_collisions": "SELECT lower(p) AS key, count(DISTINCT p) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS p FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT p) > 1",
}
