"""Queries on stores: ledger steps, claims, drift entries, anchors, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, stores
from ..operators.kept import root
from ..sources import corpus
from . import evidence_plans as ev

REASONS = ["", "seen before"]


def _updates(spark, d):
    """An update for two of three segments; status, refs and reason by the turn: a stated rule."""
    s = evidence.identified(ev.turns(spark, d))
    k = F.col("seq")
    status = F.element_at(F.array(*map(F.lit, [*stores.STATUSES, "finished"])), (k % 7 + 1).cast("int"))
    refs = lambda n, name: F.when(k % n == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return s.filter("seq % 3 < 2").select("segment_id", status.alias("status"), refs(2, "e").alias("evidence_refs"), refs(3, "p").alias("page_refs"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.lit("because")).alias("reason"))


def ledger_recorded(spark, d):
    return stores.recorded(ev.ledger(spark, d).select("source_uri", "segment_id", "status"), _updates(spark, d)).select("segment_id", "status", "error")


def ledger_finalized(spark, d):
    """Through a store on disk: written, recorded, read back."""
    store = stores.Store(spark, f"{root(spark)}/ledger")
    store.write({"ledger": ev.ledger(spark, d).select("source_uri", "segment_id", "status")})
    store.write({"ledger": stores.recorded(store.read("ledger"), _updates(spark, d)).drop("error")})
    return stores.finalized(store.read("ledger"))


def accounting(spark, d):
    """Turns as segments of their conversation's text; in every fourth conversation the second turn's hash is wrong."""
    s = evidence.identified(ev.turns(spark, d))
    conv = F.substring("source_uri", 6, 20).cast("long")
    s = s.withColumn("hash", F.when((conv % 4 == 0) & (F.col("seq") == 1), F.lit("x")).otherwise(F.col("hash")))
    content = s.groupBy("source_uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("content"))
    return stores.accounted(s, content)


def segment_kinds(spark, d):
    p = corpus.pages(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    text = F.concat(pick(["", "```\nx\n```\n", "| a |\n| b |\n", "def f():\n", "| a |\n"], n), F.col("body"))
    return p.select("path", stores.segment_kind(text, pick([None, "", "Summary of it", "Notes"], F.floor(n / 5)), n % 2 == 0).alias("kind"))


def _claims(spark, d):
    c = ev.claims(spark, d).select("claim_id", "source_uri", "segment_id", "seq")
    return c.withColumn("created_at", F.lit("old"))


def _resolutions(spark, d):
    """What became of four of five claims, by their relations and turns: a stated rule."""
    t = ev.relations(spark, d).groupBy("claim_id").agg(F.sort_array(F.collect_set("target_id")).alias("targets"), F.min("type").alias("type"))
    c = _claims(spark, d).filter("seq % 5 < 4").join(t, "claim_id", "left")
    d_ = F.when(F.col("type") == "contradicts", "contradiction").when(F.col("seq") == 2, "ambiguous").otherwise("candidate_update")
    return c.select("claim_id", "source_uri", "targets", d_.alias("disposition"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("page/"), F.col("source_uri"))).alias("target_page"))


def _syntheses(spark, d):
    return _claims(spark, d).groupBy("source_uri", F.floor(F.col("seq") / 3).alias("part")).agg(F.collect_list("claim_id").alias("claim_ids")).select(F.concat_ws("/", F.lit("syn"), "source_uri", F.col("part").cast("string")).alias("page"), "claim_ids")


def claims_upserted(spark, d):
    """Claims of every third turn come in again, and as many new ones with them."""
    c = _claims(spark, d)
    again = c.filter("seq % 3 = 0").withColumn("created_at", F.lit("new"))
    return stores.upserted(c, again.unionByName(again.withColumn("claim_id", F.concat(F.lit("more-"), F.col("claim_id"))))).select("claim_id", "created_at")


def claims_invalidated(spark, d):
    incoming = _claims(spark, d).filter("seq = 1")
    r, s = stores.invalidated(incoming, _resolutions(spark, d), _syntheses(spark, d))
    return r.select(F.lit("resolution").alias("what"), F.col("claim_id").alias("key")).unionByName(s.select(F.lit("synthesis").alias("what"), F.col("page").alias("key")))


def claim_pages(spark, d):
    return stores.pages_by_claim(_resolutions(spark, d), _syntheses(spark, d)).select("claim_id", F.array_join("pages", ",").alias("pages"))


def evidence_state(spark, d):
    return stores.evidence_status(_claims(spark, d).withColumn("segment_id", F.when(F.col("seq") % 4 > 0, F.col("segment_id"))), _resolutions(spark, d), _syntheses(spark, d))


def _files(spark, d):
    p = corpus.pages(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    return p.select("path", F.col("body").alias("content"), F.when(n % 5 == 0, "p2").otherwise("p1").alias("parser_version"), n.alias("n"))


def _fragments(spark, d):
    """Lines 1 to 3 of every page, some of a page that is gone, some stale."""
    f = _files(spark, d)
    path = F.when(F.col("n") % 7 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path"))
    return f.select(path.alias("path"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.when(F.col("n") % 3 == 0, F.lit("x")).otherwise(F.sha2("content", 256)).alias("content_hash"), F.lit("p1").alias("parser_version"), F.when(F.col("n") % 4 == 0, "module").otherwise("function").alias("kind"), F.lit("module x").alias("definition"))


def code_anchors(spark, d):
    return stores.anchors(_fragments(spark, d), _files(spark, d), "2024-01-01").select("path", "range_hash", "error")


def code_resources(spark, d):
    return stores.code_resources(_fragments(spark, d), _files(spark, d), 200)


def drift_slice(spark, d):
    """Entries of all pages; those of the languages' folders en and fr are checked anew."""
    p = corpus.pages(spark, d).select(F.concat_ws("/", "type", "path").alias("path"))
    old, new = p.withColumn("verdict", F.lit("fresh")), p.filter("path LIKE 'en/%1.md' OR path LIKE 'fr/%2.md'").withColumn("verdict", F.lit("drift_suspected"))
    return stores.sliced(old, new, ["en", "fr/"])


def telemetry(spark, d):
    """Events as telemetry, appended twice and read back strictly."""
    at = f"{root(spark)}/telemetry"
    e = corpus.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("event_type").alias("reason"), F.lit(1).cast("long").alias("query_count"), F.create_map(F.concat(F.lit("."), F.col("event_type")), F.get_json_object("props", "$.k").cast("long")).alias("extension_histogram"), F.col("event_id").alias("i"))
    for k in (0, 1):
        stores.log_telemetry(e.filter(F.col("i") % 2 == k).drop("i"), at)
    return stores.read_telemetry(spark, at).groupBy("at", "reason").agg(F.sum("query_count").alias("queries"))


def log_entries(spark, d):
    c = corpus.table(spark, d, "conversations").select(F.lit("2024-01-01").alias("at"), F.element_at(F.array(*map(F.lit, ["info", "WARN", "loud"])), (F.col("turn") % 3 + 1).cast("int")).alias("level"), F.coalesce("text", F.lit("")).alias("text"))
    return stores.log_lines(c)


def bundle_targets(spark, d):
    """Parts as scripts, every third with a metadata file beside it."""
    t = corpus.table(spark, d, "part")
    s = t.select(F.concat(F.lit("lwc/"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("path"), F.array("p_brand").alias("targets"))
    m = t.filter("p_partkey % 3 = 0").select(F.concat(F.lit("lwc/"), F.col("p_partkey").cast("string"), F.lit(".js-meta.xml")).alias("path"), F.array("p_type", "p_brand").alias("targets"))
    return stores.enriched(s, m).select("path", F.array_join("targets", ",").alias("targets"))


def path_checks(spark, d):
    """Urls without their scheme, as they are and bent, as paths."""
    u = F.regexp_replace("url", "^[a-z]+://", "")
    p = corpus.table(spark, d, "pages").select(F.explode(F.array(u, F.concat(F.lit("/"), u), F.concat(F.lit("a/../"), u), F.concat(u, F.lit("/")), F.concat(F.lit("C:"), u), F.concat(F.lit("./"), u), F.concat(F.lit("a//"), u))).alias("path")).filter("path IS NOT NULL").distinct()
    return p.select("path", stores.relative_path(F.col("path")).alias("inside"))


QUERIES = {f.__name__: f for f in (ledger_recorded, ledger_finalized, accounting, segment_kinds, claims_upserted, claims_invalidated, claim_pages, evidence_state, code_anchors, drift_slice, telemetry, log_entries, bundle_targets, path_checks)} | {"code_resource_reads": code_resources}

_UP = f"""up AS (SELECT segment_id, {[*stores.STATUSES, 'finished']!r}[seq % 7 + 1] AS s, seq % 2 = 0 AS e, seq % 3 = 0 AS p, seq % 4 <> 0 AS told FROM segs WHERE seq % 3 < 2),
err AS (SELECT segment_id, s, CASE WHEN s = 'finished' THEN 'unknown_status' WHEN s = 'integrated' AND NOT (e AND p) THEN 'needs_evidence_and_page' WHEN s = 'duplicate' AND NOT (e OR p) THEN 'needs_target' WHEN s IN {tuple(stores.NEEDS_REASON)!r} AND NOT told THEN 'needs_reason' END AS error FROM up),
rec AS (SELECT l.source_uri, l.segment_id, CASE WHEN s IS NOT NULL AND error IS NULL THEN s ELSE status END AS status, error FROM ledger l LEFT JOIN err USING (segment_id))"""
_STORE = f"""{ev._CLAIMS}, tg AS (SELECT claim_id, list_sort(list(DISTINCT target_id)) AS targets, min(type) AS type FROM rel GROUP BY claim_id),
rs AS (SELECT claim_id, source_uri, targets, CASE WHEN type = 'contradicts' THEN 'contradiction' WHEN seq = 2 THEN 'ambiguous' ELSE 'candidate_update' END AS disposition, CASE WHEN seq % 2 = 0 THEN 'page/' || source_uri END AS target_page FROM claims LEFT JOIN tg USING (claim_id) WHERE seq % 5 < 4),
sy AS (SELECT 'syn/' || source_uri || '/' || (seq // 3) AS page, list(claim_id) AS claim_ids FROM claims GROUP BY 1),
fresh AS (SELECT claim_id FROM claims WHERE seq = 1),
gone AS (SELECT claim_id FROM rs WHERE claim_id IN (SELECT claim_id FROM fresh) UNION SELECT claim_id FROM (SELECT claim_id, unnest(targets) AS t FROM rs) WHERE t IN (SELECT claim_id FROM fresh)),
bad AS (SELECT claim_id FROM fresh UNION SELECT claim_id FROM gone), lost AS (SELECT DISTINCT page FROM (SELECT page, unnest(claim_ids) AS claim_id FROM sy) WHERE claim_id IN (SELECT claim_id FROM bad))"""
_FRAG = f"""{corpus.PAGES_SQL}, f AS (SELECT path AS own, CASE WHEN doc_id % 7 = 0 THEN 'gone/' || path ELSE path END AS path, body, doc_id, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM pages_m)"""
_LEVEL = "['INFO', 'WARN', 'INFO'][turn % 3 + 1]"
ORACLES = {
    "ledger_recorded": f"WITH {ev._TURNS}, {_UP} SELECT segment_id, status, error FROM rec",
    "ledger_finalized": f"WITH {ev._TURNS}, {_UP} SELECT source_uri, count(*) FILTER (status = 'pending') AS pending, CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN 'fully_covered' ELSE 'open' END AS state FROM rec GROUP BY source_uri",
    "accounting": f"WITH {ev._TURNS} SELECT source_uri, CASE WHEN sum(length(text)) = 0 THEN false ELSE bool_and(length(text) > 0 AND NOT (conv_id % 4 = 0 AND seq = 1)) END AS complete FROM segs GROUP BY source_uri",
    "segment_kinds": f"WITH {corpus.PAGES_SQL}, t AS (SELECT path, doc_id, ['', '```' || chr(10) || 'x' || chr(10) || '```' || chr(10), '| a |' || chr(10) || '| b |' || chr(10), 'def f():' || chr(10), '| a |' || chr(10)][doc_id % 5 + 1] || body AS t, [NULL, '', 'Summary of it', 'Notes'][doc_id // 5 % 4 + 1] AS h FROM pages_m) SELECT path, CASE WHEN h = 'Summary of it' THEN 'report_section' WHEN h = 'Notes' THEN 'markdown_section' WHEN contains(t, '```') OR contains(t, '~~~') OR regexp_matches(t, '(?m)^\\s*(export |public |private |async |def |class |function |interface |type |const |func |fn )') THEN 'code_symbol' WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))) >= 2 THEN 'table_block' WHEN doc_id % 2 = 0 THEN 'bounded_chunk' ELSE 'paragraph_group' END AS kind FROM t",
    "claims_upserted": f"WITH {ev._CLAIMS} SELECT claim_id, 'old' AS created_at FROM claims UNION ALL SELECT 'more-' || claim_id, 'new' FROM claims WHERE seq % 3 = 0",
    "claims_invalidated": f"WITH {_STORE} SELECT 'resolution' AS what, claim_id AS key FROM rs WHERE claim_id NOT IN (SELECT claim_id FROM gone) UNION ALL SELECT 'synthesis', page FROM sy WHERE page NOT IN (SELECT page FROM lost)",
    "claim_pages": f"WITH {_STORE}, u AS (SELECT unnest(claim_ids) AS claim_id, page FROM sy UNION SELECT claim_id, target_page FROM rs WHERE target_page IS NOT NULL) SELECT claim_id, string_agg(page, ',' ORDER BY page) AS pages FROM u GROUP BY claim_id",
    "evidence_state": f"WITH {_STORE} SELECT (SELECT count(*) FROM claims) AS claims, (SELECT round(100.0::DOUBLE * count(*) FILTER (seq % 4 > 0) / count(*), 4) FROM claims) AS provenance_percent, (SELECT count(*) FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM rs)) + (SELECT count(*) FROM rs WHERE disposition = 'ambiguous') AS unresolved, (SELECT count(*) FROM rs WHERE disposition = 'contradiction') AS contradictions, (SELECT count(*) FROM sy) AS syntheses",
    "code_anchors": f"WITH {_FRAG}, g AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'not_indexed' WHEN doc_id % 5 = 0 THEN 'parser_changed' WHEN doc_id % 3 = 0 THEN 'stale' END AS error FROM f) SELECT path, CASE WHEN error IS NULL AND len(ls) >= 3 THEN sha256(array_to_string(list_transform(ls[1:3], lambda x: regexp_replace(x, '[\\t ]+$', '')), chr(10))) END AS range_hash, error FROM g",
    "code_resource_reads": f"WITH {_FRAG}, g AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'stale' END AS error, CASE WHEN doc_id % 4 = 0 THEN 'module x' ELSE array_to_string(ls[1:3], chr(10)) END AS t FROM f) SELECT path, 1::INTEGER AS start_line, CASE WHEN error IS NULL THEN substr(t, 1, 200) END AS text, CASE WHEN error IS NULL THEN length(t) > 200 END AS truncated, CASE WHEN error IS NULL THEN length(t)::INTEGER END AS total, error FROM g",
    "drift_slice": f"WITH {corpus.PAGES_SQL} SELECT type || '/' || path AS path, CASE WHEN type IN ('en', 'fr') THEN 'drift_suspected' ELSE 'fresh' END AS verdict FROM pages_m WHERE type NOT IN ('en', 'fr') OR (type = 'en' AND doc_id % 10 = 1) OR (type = 'fr' AND doc_id % 10 = 2)",
    "telemetry": "SELECT strftime(ts, '%Y-%m-%d') AS at, event_type AS reason, count(*) AS queries FROM events GROUP BY ALL",
    "log_entries": f"SELECT '[2024-01-01] ' || {_LEVEL} || ' ' || {ev._SQUEEZE("coalesce(text, '')")} AS line FROM conversations",
    "bundle_targets": "SELECT 'lwc/' || p_partkey || '.js' AS path, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ',' || p_type ELSE '' END AS targets FROM part",
    "path_checks": "WITH u AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS u FROM pages), p AS (SELECT DISTINCT unnest([u, '/' || u, 'a/../' || u, u || '/', 'C:' || u, './' || u, 'a//' || u]) AS path FROM u WHERE u IS NOT NULL) SELECT path, NOT regexp_matches(path, '^/|^[A-Za-z]:|\\\\|[\\x00-\\x1f\\x7f]|(^|/)\\.{1,2}(/|$)|//|/$|^$') AS inside FROM p",
}
