"""Source segments and their ledger, claims, recovery events, code anchors and snapshots."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def hashed(prefix: str, size: int, *parts: Column) -> Column:
    """Content-addressed id: prefix and the first hex digits of the hash of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size))


# ---- segments ----

_HEADING, _FENCE, _TABLE = re.compile(r"#{1,6}\s+\S"), re.compile(r"```|~~~"), re.compile(r"\|.*\|$")
_SYMBOL = re.compile(r"\s*(?:export\s+)?(?:async\s+)?(?:class|def|function|interface|enum|struct|func|fn)\b")


def cut_points(text: str, begin: int, end: int) -> dict[int, int]:
    """Places where text[begin:end] may be cut, with their priority: 5 fence edge or symbol in a fence, 4 table edge, 3 blank line, 1 line end."""
    found: dict[int, int] = {}
    fenced = table = False
    at = begin

    def note(place, priority):
        if begin < place < end:
            found[place] = max(priority, found.get(place, 0))

    for line in text[begin:end].splitlines(keepends=True):
        after, bare = at + len(line), line.strip()
        if _FENCE.match(bare):
            fenced = not fenced
            note(at, 5)
            note(after, 5)
        elif fenced and _SYMBOL.match(line):
            note(at, 5)
        is_table = bool(_TABLE.match(bare))
        if is_table != table:
            note(at, 4)
        table = is_table
        note(after, 1 if bare else 3)
        at = after
    return found


def segment(text: str, limit: int) -> list[tuple[int, int]]:
    """Half-open ranges that tile the text: sections at headings, long ones cut at the best place within `limit`."""
    starts, at = [0], 0
    for line in text.splitlines(keepends=True):
        if at and _HEADING.match(line):
            starts.append(at)
        at += len(line)
    out = []
    for begin, end in zip(starts, [*starts[1:], len(text)]):
        places = sorted(cut_points(text, begin, end).items()) if end - begin > limit else []
        while end - begin > limit:
            least = begin + min(512, int(limit * 0.35))
            near = [(p, x) for x, p in places if least <= x <= begin + limit]
            cut = max(near)[1] if near else begin + limit
            out.append((begin, cut))
            begin = cut
        if end > begin:
            out.append((begin, end))
    return out


def segments(sources: DataFrame, limit: int = 8000) -> DataFrame:
    """source_uri, seq, start, end, text, hash, segment_id of sources (source_uri, content): lossless and content-addressed."""

    def cut(parts):
        for part in parts:
            rows = [(u, i, a, b, t[a:b]) for u, t in zip(part["source_uri"], part["content"]) if t for i, (a, b) in enumerate(segment(t, limit))]
            yield pd.DataFrame(rows, columns=["source_uri", "seq", "start", "end", "text"])

    cut_ = sources.select("source_uri", "content").mapInPandas(cut, "source_uri string, seq int, start long, end long, text string")
    return identified(cut_)


def identified(segs: DataFrame) -> DataFrame:
    """Adds hash, occurrence (running count of an equal hash in its source) and segment_id to (source_uri, seq, text)."""
    h = segs.withColumn("hash", F.sha2("text", 256))
    h = h.withColumn("occurrence", F.row_number().over(W.partitionBy("source_uri", "hash").orderBy("seq")) - 1)
    return h.withColumn("segment_id", hashed("seg-", 24, F.lit("source-segment-v1"), F.col("source_uri"), F.col("hash"), F.col("occurrence").cast("string")))


def contiguity(segs: DataFrame) -> DataFrame:
    """source_uri, complete: each segment starts where the one before ends, the first at 0."""
    before = F.lag("end", 1, 0).over(W.partitionBy("source_uri").orderBy("seq"))
    return segs.withColumn("_ok", F.col("start") == before).groupBy("source_uri").agg(F.bool_and("_ok").alias("complete"), F.max("end").alias("length"))


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """source_uri, total, processed, pending, evidence, skipped, percent (100 if there is nothing)."""
    g = ledger.groupBy("source_uri").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "pending").alias("processed"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "evidence_recorded").alias("evidence"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    return g.withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100 * F.col("processed") / F.col("total"), 4)))


def reused(new: DataFrame, old: DataFrame) -> DataFrame:
    """New segments with the status that the same (segment_id, hash) had; others are pending."""
    return new.join(old.select("segment_id", "hash", F.col("status").alias("_old")), ["segment_id", "hash"], "left").withColumn("status", F.coalesce("_old", F.lit("pending"))).drop("_old")


# ---- claims ----

def normalized_claim(text: Column) -> Column:
    return F.lower(T.squeezed(text))


_PAGE_OF = {"requirement": "requirement", "constraint": "requirement", "invariant": "requirement", "exception": "requirement", "decision": "decision", "risk": "risk", "incident": "analysis", "behavior": "implementation", "procedure": "implementation"}
_DIRECTORY = {"requirement": "requirements", "decision": "decisions", "risk": "risks", "implementation": "implementations", "analysis": "analysis"}


def proposed_path(kind: Column, text: Column) -> Column:
    """The page that a claim without a target would make."""
    pairs = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    page = F.coalesce(pairs(_PAGE_OF)[kind], F.lit("analysis"))
    title = F.concat(kind, F.lit(": "), T.squeezed(F.substring(text, 1, 72)))
    return F.concat(pairs(_DIRECTORY)[page], F.lit("/"), T.slug(title, "evidence"), F.lit(".md"))


def claim_id(source_uri: Column, segment_id: Column, text: Column, kind: Column, origin: Column) -> Column:
    return hashed("claim-", 32, F.lit("evidence-claim-v1"), source_uri, segment_id, T.squeezed(text), kind, origin)


def duplicates(claims: DataFrame) -> DataFrame:
    """claim_id, first_id: claims whose text and proposed page a claim of a smaller id has already. Groups meet by their smallest id, no pairs."""
    keyed = claims.select("claim_id", F.sha2(normalized_claim(F.col("text")), 256).alias("_t"), proposed_path(F.col("kind"), F.col("text")).alias("_p"))
    first = keyed.groupBy("_t", "_p").agg(F.min("claim_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(first, ["_t", "_p"]).filter("claim_id > first_id").select("claim_id", "first_id")


def resolutions(claims: DataFrame, relations: DataFrame, pages: DataFrame) -> DataFrame:
    """claim_id, disposition, reason: an explicit contradiction, else a supersession, else a duplicate (stated or by text),
    else the pages whose title is the claim's anchor: one, several or none. relations: claim_id, type, target_id; claims carry `anchor`."""
    stated = relations.groupBy("claim_id").agg(F.max(F.when(F.col("type") == "contradicts", 3).when(F.col("type") == "supersedes", 2).otherwise(1)).alias("_r"))
    keys = pages.groupBy(F.lower("title").alias("_k")).agg(F.countDistinct("path").alias("_pages"))
    c = claims.join(stated, "claim_id", "left").join(duplicates(claims), "claim_id", "left").join(keys, F.lower("anchor") == F.col("_k"), "left")
    pick = lambda a, b, d, m, n: F.when(F.col("_r") == 3, a).when(F.col("_r") == 2, b).when((F.col("_r") == 1) | F.col("first_id").isNotNull(), d).when(F.col("_pages") == 1, m).when(F.col("_pages") > 1, n)
    return c.select("claim_id", pick("contradiction", "supersedes", "duplicate", "candidate_update", "ambiguous").otherwise("candidate_new_page").alias("disposition"))


def statuses(claims: DataFrame, resolved: DataFrame, relations: DataFrame) -> DataFrame:
    """claim_id, status: the strongest effect on a claim of its own and others' resolutions."""
    r = resolved.join(relations.withColumnRenamed("type", "_type"), "claim_id", "left")
    own = r.select("claim_id", F.when(F.col("disposition") == "ambiguous", 1).when(F.col("disposition") == "contradiction", 3).otherwise(0).alias("p"))
    other = r.filter("target_id IS NOT NULL").select(F.col("target_id").alias("claim_id"), F.when((F.col("disposition") == "supersedes") & (F.col("_type") == "supersedes"), 2).when((F.col("disposition") == "contradiction") & (F.col("_type") == "contradicts"), 3).otherwise(0).alias("p"))
    worst = own.unionByName(other).groupBy("claim_id").agg(F.max("p").alias("p"))
    names = F.array(*(F.lit(s) for s in sorted(vocab.CLAIM_STATUS_PRIORITY, key=vocab.CLAIM_STATUS_PRIORITY.get)))
    return claims.select("claim_id").join(worst, "claim_id", "left").select("claim_id", F.element_at(names, F.coalesce("p", F.lit(0)) + 1).alias("status"))


def reconciled(segs: DataFrame, claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """segment_id, status, claims: pending without claims; ambiguous while one of its claims is; else evidence_recorded."""
    per = claims.select("segment_id", "claim_id").join(resolved, "claim_id", "left").groupBy("segment_id").agg(F.count("*").alias("claims"), F.count_if(F.col("disposition") == "ambiguous").alias("_open"))
    return segs.select("segment_id").join(per, "segment_id", "left").select("segment_id", F.when(F.col("claims").isNull(), "pending").when(F.col("_open") > 0, "ambiguous").otherwise("evidence_recorded").alias("status"), F.coalesce("claims", F.lit(0)).alias("claims"))


# ---- recovery ----

def recovery_events(usage: DataFrame) -> DataFrame:
    """recovery_id, source_uri, evidence_ref, occurrences, first_seen, last_seen, status of usages (source_uri, evidence_ref, ts, resolved): an event counts its
    usages and is pending again after a usage later than its last resolution."""
    rid = hashed("recovery-", 32, F.lit("knowledge-recovery-v1"), F.col("source_uri"), F.col("evidence_ref"))
    g = usage.groupBy("source_uri", "evidence_ref").agg(F.count_if(~F.col("resolved")).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.when(F.col("resolved"), F.col("ts"))).alias("_r"), F.max(F.when(~F.col("resolved"), F.col("ts"))).alias("_u"))
    return g.select(rid.alias("recovery_id"), "source_uri", "evidence_ref", "occurrences", "first_seen", "last_seen", F.when(F.col("_r").isNotNull() & (F.col("_u").isNull() | (F.col("_r") >= F.col("_u"))), "resolved").otherwise("pending").alias("status"))


def recovery_metrics(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.round(F.coalesce(F.count_if(F.col("status") == "resolved") / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)), 6).alias("rate"))


# ---- drift ----

def drift(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchor_id, path, verdict, reason of anchors (anchor_id, path, start_line, end_line, range_hash, parser_version) against files (path, content, parser_version)."""
    f = files.select("path", "content", F.col("parser_version").alias("_now"))
    a = anchors.join(f, "path", "left").withColumn("_seen", T.range_hash(F.col("content"), F.col("start_line"), F.col("end_line")))
    reason = F.when(F.col("content").isNull(), "file_missing").when(F.col("_seen").isNull(), "range_out_of_bounds").when(F.col("_seen") != F.col("range_hash"), "content_changed").when(~F.col("_now").eqNullSafe(F.col("parser_version")), "parser_version_changed")
    fresh = reason.isNull() | (reason == "parser_version_changed")
    return a.select("anchor_id", "path", F.when(fresh, "fresh").otherwise("drift_suspected").alias("verdict"), F.coalesce(reason, F.lit("")).alias("reason"))


def drift_summary(entries: DataFrame) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return entries.agg(F.count("*").alias("anchors"), count("verdict", "fresh"), *(count("reason", r) for r in ("file_missing", "range_out_of_bounds", "content_changed", "parser_version_changed")))


def stale_by_page(entries: DataFrame, links: DataFrame) -> DataFrame:
    """page, stale, unresolvable: anchors that a page (links: anchor_id, page) cites and that drifted; a missing file makes it unresolvable."""
    bad = entries.filter("verdict = 'drift_suspected'").join(links, "anchor_id")
    return bad.groupBy("page").agg(F.countDistinct("anchor_id").alias("stale"), F.max(F.col("reason") == "file_missing").alias("unresolvable"))


# ---- snapshots ----

def manifest(files: DataFrame) -> DataFrame:
    """path, size, sha256 of files (path, content), line ends as LF; deterministic."""
    norm = F.regexp_replace("content", "\r\n?", "\n")
    return files.select("path", F.octet_length(norm).cast("long").alias("size"), F.sha2(norm, 256).alias("sha256"))


def collisions(entries: DataFrame) -> DataFrame:
    """Paths that differ in letter case only: key, n."""
    return entries.groupBy(F.lower("path").alias("key")).agg(F.countDistinct("path").alias("n")).filter("n > 1")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two manifests."""
    a, b = old.select("path", F.col("sha256").alias("_a")), new.select("path", F.col("sha256").alias("_b"))
    both = a.join(b, "path", "full").filter("NOT (_a <=> _b)")
    return both.select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def corpus_digest(entries: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: digest of a manifest. Entries are digested by the first hex digits of their path's hash, then the digests in order, so no
    task needs all paths."""
    line = F.concat_ws("\0", "path", F.col("size").cast("string"), "sha256")
    part = entries.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("digest"))
    return part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digest"))


def merged_on_read(snapshot: DataFrame, deltas: DataFrame, key: str = "path") -> DataFrame:
    """A snapshot with a log of changes (its columns plus seq, deleted) replayed: the last change of a key wins, deletions drop it."""
    last = deltas.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).filter("_rn = 1")
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("NOT deleted").select(*snapshot.columns))
