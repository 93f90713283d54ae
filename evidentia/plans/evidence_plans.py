"""Queries on segments, claims, recovery events, drift and snapshots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence
from ..sources import corpus

KINDS = ["fact", "requirement", "decision", "risk", "incident", "behavior"]


def turns(spark, d):
    """A conversation as a source, its turns as segments with offsets."""
    c = corpus.table(spark, d, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("source_uri"), F.col("turn").cast("int").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), "role")
    end = F.sum(F.length("text")).over(W.partitionBy("source_uri").orderBy("seq"))
    return c.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def ledger(spark, d):
    s = evidence.identified(turns(spark, d))
    return s.withColumn("status", F.when(F.col("seq") % 3 == 0, "pending").when(F.col("seq") % 3 == 1, "evidence_recorded").otherwise("skipped"))


def segment_ids(spark, d):
    return evidence.identified(turns(spark, d)).select("source_uri", "seq", "segment_id", "occurrence")


def segment_contiguity(spark, d):
    return evidence.contiguity(turns(spark, d))


def segment_sources(spark, d):
    s = corpus.pages(spark, d).select(F.col("path").alias("source_uri"), F.col("body").alias("content"))
    return evidence.segments(s, 800).select("source_uri", "seq", "start", "end", "segment_id")


def ledger_metrics(spark, d):
    return evidence.ledger_metrics(ledger(spark, d))


def ledger_reuse(spark, d):
    old = ledger(spark, d).filter("seq % 2 = 0").select("segment_id", "hash", "status")
    return evidence.reused(evidence.identified(turns(spark, d)), old).select("segment_id", "status")


def claims(spark, d):
    """One claim per turn: its text (in every fifth conversation one sentence by the turn's place), its kind by the turn, its anchor the title of a page; stated rules."""
    s = evidence.identified(turns(spark, d))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("seq") % 6 + 1).cast("int"))
    c = s.select("source_uri", "segment_id", "seq", "text", kind.alias("kind"))
    conv = F.substring("source_uri", 6, 20).cast("long")
    c = c.withColumn("text", F.when(conv % 5 == 0, F.concat(F.lit("Turn "), F.col("seq").cast("string"), F.lit(" states one thing."))).otherwise(F.col("text")))
    c = c.withColumn("anchor", F.when(conv % 3 == 0, F.concat(F.lit("document "), conv.cast("string"))).when(conv % 3 == 1, F.lit("shared title")).otherwise(F.lit("nothing")))
    return c.withColumn("claim_id", evidence.claim_id(F.col("source_uri"), F.col("segment_id"), F.col("text"), F.col("kind"), F.lit("extracted")))


def relations(spark, d):
    """Every fourth turn contradicts the turn before it, every fifth supersedes it; a stated rule."""
    c = claims(spark, d)
    before = F.lag("claim_id").over(W.partitionBy("source_uri").orderBy("seq"))
    r = c.withColumn("target_id", before).withColumn("type", F.when(F.col("seq") % 4 == 3, "contradicts").when(F.col("seq") % 5 == 4, "supersedes"))
    return r.filter("type IS NOT NULL AND target_id IS NOT NULL").select("claim_id", "type", "target_id")


def titled(spark, d):
    p = corpus.pages(spark, d).select("path", "title")
    return p.unionByName(p.filter("path < 'doc/000000003'").select("path", F.lit("Shared title").alias("title")))


def claim_duplicates(spark, d):
    return evidence.duplicates(claims(spark, d))


def claim_resolution(spark, d):
    return evidence.resolutions(claims(spark, d), relations(spark, d), titled(spark, d))


def claim_status(spark, d):
    return evidence.statuses(claims(spark, d), claim_resolution(spark, d), relations(spark, d))


def reconcile(spark, d):
    c = claims(spark, d)
    return evidence.reconciled(evidence.identified(turns(spark, d)), c.filter("seq % 3 > 0"), claim_resolution(spark, d))


def usage(spark, d):
    e = corpus.table(spark, d, "events")
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_uri"), F.col("event_type").alias("evidence_ref"), "ts", (F.col("event_id") % 4 == 0).alias("resolved"))


def recovery_events(spark, d):
    return evidence.recovery_events(usage(spark, d))


def recovery_metrics(spark, d):
    return evidence.recovery_metrics(recovery_events(spark, d))


def _anchors(spark, d):
    """An anchor on the first two lines of every document; by id the file is gone, changed, re-spaced, cut, newly parsed or as it was."""
    p = corpus.table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    last = F.least(F.lit(2), F.size(F.split("content", "\n")))
    a = p.select(F.col("doc_id").alias("anchor_id"), "path", F.lit(1).alias("start_line"), last.alias("end_line"), T.range_hash(F.col("content"), F.lit(1), last).alias("range_hash"), F.lit("v1").alias("parser_version"))
    by = F.col("doc_id") % 6
    now = F.when(by == 1, F.concat(F.lit("x"), F.col("content"))).when(by == 2, F.regexp_replace("content", "\n", " \t\n")).when(by == 3, F.element_at(F.split("content", "\n"), 1)).otherwise(F.col("content"))
    return a, p.filter(by != 0).select("path", now.alias("content"), F.when(by == 4, "v2").otherwise("v1").alias("parser_version"))


def drift_verdicts(spark, d):
    return evidence.drift(*_anchors(spark, d))


def drift_summary(spark, d):
    return evidence.drift_summary(drift_verdicts(spark, d))


def stale_by_page(spark, d):
    links = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("anchor_id"), F.concat(F.lit("page/"), F.floor(F.col("doc_id") / 10).cast("string")).alias("page"))
    return evidence.stale_by_page(drift_verdicts(spark, d), links)


def _files(spark, d):
    return corpus.pages(spark, d).select("path", F.col("body").alias("content"))


def manifest(spark, d):
    return evidence.manifest(_files(spark, d))


def snapshot_diff(spark, d):
    f = _files(spark, d)
    n = F.substring("path", 5, 9).cast("long") % 7
    return evidence.snapshot_diff(evidence.manifest(f.filter(n != 0)), evidence.manifest(f.filter(n != 1).withColumn("content", F.when(n == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))))


def corpus_digest(spark, d):
    return evidence.corpus_digest(manifest(spark, d))


def delta_replay(spark, d):
    m = manifest(spark, d)
    n = F.substring("path", 5, 9).cast("long")
    log = m.filter(n % 3 == 0).select("path", (F.col("size") + 1).alias("size"), "sha256", F.lit(1).alias("seq"), F.lit(False).alias("deleted")).unionByName(m.filter(n % 6 == 0).select("path", "size", "sha256", F.lit(2).alias("seq"), F.lit(True).alias("deleted")))
    return evidence.merged_on_read(m, log)


QUERIES = {f.__name__: f for f in (segment_ids, segment_contiguity, segment_sources, ledger_metrics, ledger_reuse, claim_duplicates, claim_resolution, claim_status, reconcile, recovery_events, recovery_metrics, drift_verdicts, drift_summary, stale_by_page, manifest, snapshot_diff, corpus_digest, delta_replay)}

_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[\\x09-\\x0D\\x20]+', ' ', 'g'), ' ')"
_TURNS = """turns AS (SELECT 'conv:' || conv_id AS source_uri, conv_id, turn::INTEGER AS seq, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS hash FROM conversations),
segs AS (SELECT *, 'seg-' || substr(sha256('source-segment-v1' || chr(0) || source_uri || chr(0) || hash || chr(0) || occurrence), 1, 24) AS segment_id FROM
  (SELECT *, (row_number() OVER (PARTITION BY source_uri, hash ORDER BY seq) - 1)::INTEGER AS occurrence, sum(length(text)) OVER (PARTITION BY source_uri ORDER BY seq) AS fin FROM turns)),
ledger AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'evidence_recorded' ELSE 'skipped' END AS status FROM segs)"""
_CLAIMS = f"""{_TURNS}, c0 AS (SELECT source_uri, segment_id, seq, CASE WHEN conv_id % 5 = 0 THEN 'Turn ' || seq || ' states one thing.' ELSE text END AS text, {KINDS!r}[seq % 6 + 1] AS kind,
  CASE conv_id % 3 WHEN 0 THEN 'document ' || conv_id WHEN 1 THEN 'shared title' ELSE 'nothing' END AS anchor FROM segs),
claims AS (SELECT *, 'claim-' || substr(sha256('evidence-claim-v1' || chr(0) || source_uri || chr(0) || segment_id || chr(0) || {_SQUEEZE('text')} || chr(0) || kind || chr(0) || 'extracted'), 1, 32) AS claim_id,
  CASE WHEN kind = 'requirement' THEN 'requirements' WHEN kind = 'decision' THEN 'decisions' WHEN kind = 'risk' THEN 'risks' WHEN kind = 'behavior' THEN 'implementations' ELSE 'analysis' END || '/' || kind AS dir FROM c0),
rel AS (SELECT * FROM (SELECT claim_id, CASE WHEN seq % 4 = 3 THEN 'contradicts' WHEN seq % 5 = 4 THEN 'supersedes' END AS type, lag(claim_id) OVER (PARTITION BY source_uri ORDER BY seq) AS target_id FROM claims) WHERE type IS NOT NULL AND target_id IS NOT NULL),
grp AS (SELECT dir, lower({_SQUEEZE('text')}) AS t, min(claim_id) AS first_id FROM claims GROUP BY 1, 2 HAVING count(*) > 1),
dup AS (SELECT claim_id, first_id FROM claims JOIN grp ON claims.dir = grp.dir AND lower({_SQUEEZE('text')}) = t WHERE claim_id > first_id),
titles AS (SELECT lower('Document ' || doc_id) AS k, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'shared title', count(*) FROM documents WHERE doc_id < 3),
res AS (SELECT claim_id, CASE WHEN r = 3 THEN 'contradiction' WHEN r = 2 THEN 'supersedes' WHEN first_id IS NOT NULL THEN 'duplicate' WHEN n = 1 THEN 'candidate_update' WHEN n > 1 THEN 'ambiguous' ELSE 'candidate_new_page' END AS disposition
  FROM claims LEFT JOIN (SELECT claim_id, max(CASE WHEN type = 'contradicts' THEN 3 ELSE 2 END) AS r FROM rel GROUP BY 1) USING (claim_id) LEFT JOIN dup USING (claim_id) LEFT JOIN titles ON lower(anchor) = k)"""
_RECOVERY = """ev AS (SELECT 'user:' || user_id AS source_uri, event_type AS evidence_ref, ts, event_id % 4 = 0 AS resolved FROM events),
rec AS (SELECT 'recovery-' || substr(sha256('knowledge-recovery-v1' || chr(0) || source_uri || chr(0) || evidence_ref), 1, 32) AS recovery_id, source_uri, evidence_ref, count(*) FILTER (NOT resolved) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen,
  CASE WHEN max(ts) FILTER (resolved) IS NOT NULL AND (max(ts) FILTER (NOT resolved) IS NULL OR max(ts) FILTER (resolved) >= max(ts) FILTER (NOT resolved)) THEN 'resolved' ELSE 'pending' END AS status FROM ev GROUP BY source_uri, evidence_ref)"""
_DRIFT = """dd AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
dr AS (SELECT doc_id AS anchor_id, 'doc/' || doc_id AS path, CASE doc_id % 6 WHEN 0 THEN 'file_missing' WHEN 1 THEN 'content_changed' WHEN 3 THEN CASE WHEN len(ls) > 1 THEN 'range_out_of_bounds' ELSE '' END WHEN 4 THEN 'parser_version_changed' ELSE '' END AS reason FROM dd),
drift AS (SELECT anchor_id, path, CASE WHEN reason IN ('', 'parser_version_changed') THEN 'fresh' ELSE 'drift_suspected' END AS verdict, reason FROM dr)"""
_MANIFEST = f"{corpus.PAGES_SQL}, man AS (SELECT path, doc_id, strlen(body)::BIGINT AS size, sha256(body) AS sha256 FROM (SELECT path, doc_id, regexp_replace(body, '\\r\\n?', chr(10), 'g') AS body FROM pages_m))"
ORACLES = {
    "segment_ids": f"WITH {_TURNS} SELECT source_uri, seq, segment_id, occurrence FROM segs",
    "segment_contiguity": f"WITH {_TURNS} SELECT source_uri, true AS complete, max(fin)::BIGINT AS length FROM segs GROUP BY source_uri",
    "ledger_metrics": f"WITH {_TURNS} SELECT source_uri, count(*) AS total, count(*) FILTER (status <> 'pending') AS processed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'evidence_recorded') AS evidence, count(*) FILTER (status = 'skipped') AS skipped, round(100.0::DOUBLE * count(*) FILTER (status <> 'pending') / count(*), 4) AS percent FROM ledger GROUP BY source_uri",
    "ledger_reuse": f"WITH {_TURNS} SELECT segment_id, CASE WHEN seq % 2 = 0 THEN status ELSE 'pending' END AS status FROM ledger",
    "claim_duplicates": f"WITH {_CLAIMS} SELECT claim_id, first_id FROM dup",
    "claim_resolution": f"WITH {_CLAIMS} SELECT claim_id, disposition FROM res",
    "claim_status": f"""WITH {_CLAIMS}, fx AS (SELECT claim_id, CASE disposition WHEN 'ambiguous' THEN 1 WHEN 'contradiction' THEN 3 ELSE 0 END AS p FROM res
  UNION ALL SELECT target_id, CASE WHEN disposition = 'supersedes' AND type = 'supersedes' THEN 2 WHEN disposition = 'contradiction' AND type = 'contradicts' THEN 3 ELSE 0 END FROM res JOIN rel USING (claim_id))
SELECT c.claim_id, ['active', 'ambiguous', 'superseded', 'contradicted'][coalesce(p, 0) + 1] AS status FROM claims c LEFT JOIN (SELECT claim_id, max(p) AS p FROM fx GROUP BY 1) USING (claim_id)""",
    "reconcile": f"WITH {_CLAIMS}, per AS (SELECT segment_id, count(*) AS claims, count(*) FILTER (disposition = 'ambiguous') AS o FROM claims JOIN res USING (claim_id) WHERE seq % 3 > 0 GROUP BY 1) SELECT segment_id, CASE WHEN claims IS NULL THEN 'pending' WHEN o > 0 THEN 'ambiguous' ELSE 'evidence_recorded' END AS status, coalesce(claims, 0) AS claims FROM segs LEFT JOIN per USING (segment_id)",
    "recovery_events": f"WITH {_RECOVERY} SELECT recovery_id, source_uri, evidence_ref, occurrences, first_seen, last_seen, status FROM rec",
    "recovery_metrics": f"WITH {_RECOVERY} SELECT count(*) AS events, sum(occurrences)::BIGINT AS occurrences, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'resolved') AS resolved, round(count(*) FILTER (status = 'resolved')::DOUBLE / count(*), 6) AS rate FROM rec",
    "drift_verdicts": f"WITH {_DRIFT} SELECT anchor_id, path, verdict, reason FROM drift",
    "drift_summary": f"WITH {_DRIFT} SELECT count(*) AS anchors, count(*) FILTER (verdict = 'fresh') AS fresh, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("file_missing", "range_out_of_bounds", "content_changed", "parser_version_changed")) + " FROM drift",
    "stale_by_page": f"WITH {_DRIFT} SELECT 'page/' || (anchor_id // 10) AS page, count(*) AS stale, bool_or(reason = 'file_missing') AS unresolvable FROM drift WHERE verdict = 'drift_suspected' GROUP BY 1",
    "manifest": f"WITH {_MANIFEST} SELECT path, size, sha256 FROM man",
    "snapshot_diff": f"WITH {_MANIFEST} SELECT path, CASE doc_id % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM man WHERE doc_id % 7 <= 2",
    "corpus_digest": f"WITH {_MANIFEST}, b AS (SELECT substr(sha256(path), 1, 2) AS bucket, sha256(string_agg(path || chr(0) || size || chr(0) || sha256, chr(10) ORDER BY path)) AS digest FROM man GROUP BY 1) SELECT sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest FROM b",
    "delta_replay": f"WITH {_MANIFEST} SELECT path, CASE WHEN doc_id % 3 = 0 THEN size + 1 ELSE size END AS size, sha256 FROM man WHERE doc_id % 6 <> 0",
}
