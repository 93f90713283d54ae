"""State that is read, checked and written anew: the coverage ledger, claims with what follows from them, drift entries,
recovery counters, code anchors and telemetry. Every step gives the new state as a table; `Store` keeps its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# What a segment's status must come with.
NEEDS_REASON = ["irrelevant", "unresolved", "contradicted", "legacy_unverified"]
STATUSES = ["integrated", "duplicate", *NEEDS_REASON]


class Store:
    """Tables under a folder in whole versions. A version counts once its number is written; checks that fail write nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        try:
            return self.spark.read.schema("version long").parquet(f"{self.root}/versions").agg(F.max("version")).first()[0] or 0
        except Exception as e:  # the folder isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.version()}/{name}")

    def write(self, tables: dict[str, DataFrame], checks: dict[str, DataFrame] | None = None) -> int:
        """Writes all tables as one version, unless one of the checks (rows that break a rule) has a row."""
        for rule, broken in (checks or {}).items():
            row = broken.first()
            if row is not None:
                raise ValueError(f"{rule}: {row.asDict()}")
        v = self.version() + 1
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.root}/v{v}/{name}")
        self.spark.createDataFrame([(v,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return v


# ---- coverage ledger ----

def resolution_error(status: Column, evidence_refs: Column, page_refs: Column, reason: Column) -> Column:
    """Why a segment can't have a status; null if it can."""
    e, p, told = F.coalesce(F.size(evidence_refs), F.lit(0)) > 0, F.coalesce(F.size(page_refs), F.lit(0)) > 0, F.coalesce(F.trim(reason), F.lit("")) != ""
    return (
        F.when(~F.coalesce(status.isin(STATUSES), F.lit(False)), "unknown_status").when((status == "integrated") & ~(e & p), "needs_evidence_and_page")
        .when((status == "duplicate") & ~(e | p), "needs_target").when(status.isin(NEEDS_REASON) & ~told, "needs_reason")
    )


def recorded(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger (segment_id, status, ...) after updates (segment_id, status, evidence_refs, page_refs, reason): allowed ones take
    effect, others are told in `error`."""
    u = updates.select("segment_id", F.col("status").alias("_s"), resolution_error(F.col("status"), F.col("evidence_refs"), F.col("page_refs"), F.col("reason")).alias("error"))
    out = ledger.join(u, "segment_id", "left")
    return out.withColumn("status", F.when(F.col("_s").isNotNull() & F.col("error").isNull(), F.col("_s")).otherwise(F.col("status"))).drop("_s")


def finalized(ledger: DataFrame) -> DataFrame:
    """source_uri, pending, state of every source: fully_covered once nothing is pending."""
    g = ledger.groupBy("source_uri").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return g.withColumn("state", F.when(F.col("pending") == 0, "fully_covered").otherwise("open"))


def accounted(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """source_uri, complete: segments (source_uri, seq, start, end, hash) without gap or overlap, with the hashes of their text, up to
    the end of the source's content."""
    s = segments.join(sources, "source_uri", "right")
    before = F.lag("end", 1, 0).over(W.partitionBy("source_uri").orderBy("seq"))
    right = (F.col("start") == before) & (F.col("end") > F.col("start")) & (F.sha2(F.substring(F.col("content"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), 256) == F.col("hash"))
    g = s.withColumn("_ok", right).groupBy("source_uri").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("all"), F.max("end").alias("last"), F.count("seq").alias("n"), F.max(F.length("content")).alias("size"))
    return g.select("source_uri", F.when(F.col("size") == 0, F.col("n") == 0).otherwise(F.col("all") & (F.col("last") == F.col("size"))).alias("complete"))


def segment_kind(text: Column, heading: Column, hard_split: Column) -> Column:
    """What a segment is, by its heading and lines."""
    lines = F.split(text, "\r?\n")
    code = text.rlike(r"```|~~~") | F.exists(lines, lambda x: x.rlike(r"^\s*(export |public |private |async |def |class |function |interface |type |const |func |fn )"))
    table = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$"))) >= 2
    report = heading.rlike(r"(?i)^(summary|request|requirements?|implementation|tests?|decisions?|risks?|release)")
    return F.when(heading.isNotNull() & (heading != "") & report, "report_section").when(heading.isNotNull() & (heading != ""), "markdown_section").when(code, "code_symbol").when(table, "table_block").when(hard_split, "bounded_chunk").otherwise("paragraph_group")


# ---- claims ----

def upserted(claims: DataFrame, incoming: DataFrame) -> DataFrame:
    """Claims by claim_id; an incoming one takes the place of an older one, whose created_at it keeps."""
    old = claims.select("claim_id", F.col("created_at").alias("_c"))
    new = incoming.join(old, "claim_id", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c")
    return claims.join(incoming.select("claim_id"), "claim_id", "left_anti").unionByName(new.select(*claims.columns))


def invalidated(incoming: DataFrame, resolutions: DataFrame, syntheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolutions, syntheses) that stay when claims come in: a resolution goes with its claim or one it aims at, a synthesis with
    a claim that came in or lost its resolution. resolutions: claim_id, targets; syntheses: page, claim_ids."""
    fresh = incoming.select("claim_id").distinct()
    hit = resolutions.select(F.col("claim_id").alias("owner"), F.explode(F.concat(F.array("claim_id"), F.coalesce("targets", F.array().cast("array<string>")))).alias("claim_id")).join(fresh, "claim_id", "left_semi")
    gone = hit.select(F.col("owner").alias("claim_id")).distinct()
    lost = syntheses.select("page", F.explode("claim_ids").alias("claim_id")).join(fresh.union(gone).distinct(), "claim_id", "left_semi").select("page").distinct()
    return resolutions.join(gone, "claim_id", "left_anti"), syntheses.join(lost, "page", "left_anti")


def pages_by_claim(resolutions: DataFrame, syntheses: DataFrame) -> DataFrame:
    """claim_id, pages (sorted): pages that a claim went into, by synthesis or as its target (target_page)."""
    a = syntheses.select(F.explode("claim_ids").alias("claim_id"), "page")
    b = resolutions.filter("target_page IS NOT NULL").select("claim_id", F.col("target_page").alias("page"))
    return a.unionByName(b).groupBy("claim_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def evidence_status(claims: DataFrame, resolutions: DataFrame, syntheses: DataFrame) -> DataFrame:
    """One row: claims, their share with a source and a segment (100 if none), unresolved links, contradictions, syntheses."""
    c = claims.join(resolutions.select("claim_id", F.lit(1).alias("_r")).distinct(), "claim_id", "left")
    a = c.agg(F.count("*").alias("claims"), F.count_if(F.col("source_uri").isNotNull() & F.col("segment_id").isNotNull()).alias("_p"), F.count_if(F.col("_r").isNull()).alias("_open"))
    b = resolutions.agg(F.count_if(F.col("disposition") == "ambiguous").alias("_ambiguous"), F.count_if(F.col("disposition") == "contradiction").alias("contradictions"))
    s = syntheses.agg(F.count("*").alias("syntheses"))
    one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(s))
    return one.select("claims", F.when(F.col("claims") == 0, 100.0).otherwise(F.round(100 * F.col("_p") / F.col("claims"), 4)).alias("provenance_percent"), (F.col("_open") + F.col("_ambiguous")).alias("unresolved"), "contradictions", "syntheses")


# ---- drift entries, code anchors and resources ----

def under(path: Column, prefixes: list[str]) -> Column:
    """True for a path that is one of the prefixes or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def sliced(old: DataFrame, new: DataFrame, prefixes: list[str] | None) -> DataFrame:
    """Drift entries after a check of some paths: the entries under the prefixes (all, if None) are the new ones."""
    return new if prefixes is None else old.filter(~under(F.col("path"), prefixes)).unionByName(new.select(*old.columns))


def anchors(fragments: DataFrame, files: DataFrame, captured_at: str) -> DataFrame:
    """Code anchors of fragments (path, start_line, end_line, content_hash, parser_version) in files (path, content, parser_version);
    error tells why there is none."""
    f = fragments.join(files.select("path", "content", F.col("parser_version").alias("_now")), "path", "left")
    error = F.when(F.col("content").isNull(), "not_indexed").when(~F.col("_now").eqNullSafe(F.col("parser_version")), "parser_changed").when(F.sha2("content", 256) != F.col("content_hash"), "stale")
    return f.select("path", "start_line", "end_line", F.when(error.isNull(), T.range_hash(F.col("content"), F.col("start_line"), F.col("end_line"))).alias("range_hash"), "parser_version", F.lit(captured_at).alias("captured_at"), error.alias("error"))


def bounded(text: Column, limit: int, suffix: str = "") -> Column:
    """A text of at most `limit` characters; a longer one is cut and gets the suffix."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def code_resources(fragments: DataFrame, files: DataFrame, limit: int = 12_000) -> DataFrame:
    """path, start_line, text, truncated, total, error of fragments (path, kind, definition, start_line, end_line, content_hash): the
    lines of the file, of a module its definition alone."""
    f = fragments.join(files.select("path", "content"), "path", "left")
    lines = F.slice(F.split("content", "\r?\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    body = F.when(F.col("kind") == "module", F.col("definition")).otherwise(F.array_join(lines, "\n"))
    error = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("content_hash"), "stale")
    return f.select("path", "start_line", F.when(error.isNull(), bounded(body, limit)).alias("text"), F.when(error.isNull(), F.length(body) > limit).alias("truncated"), F.when(error.isNull(), F.length(body)).alias("total"), error.alias("error"))


# ---- recovery and telemetry ----

def recovery_errors(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Rows that break the recovery store's rules: event ids twice, no occurrence, counters (usages) other than the sum."""
    twice = events.groupBy("recovery_id").agg(F.count("*").alias("n")).filter("n > 1").select("recovery_id", F.lit("twice").alias("rule"))
    none = events.filter("occurrences < 1").select("recovery_id", F.lit("no_occurrence").alias("rule"))
    total = events.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total")).crossJoin(F.broadcast(counters.select("usages"))).filter("total <> usages").select(F.lit(None).cast("string").alias("recovery_id"), F.lit("counter").alias("rule"))
    return twice.unionByName(none).unionByName(total)


TELEMETRY = "at string, reason string, query_count long, extension_histogram map<string,long>"


def log_telemetry(events: DataFrame, root: str) -> None:
    """Appends events to JSON lines."""
    events.write.mode("append").json(root)


def read_telemetry(spark: SparkSession, root: str) -> DataFrame:
    """Strict: a line that isn't an event of this shape raises."""
    return spark.read.schema(TELEMETRY).option("mode", "FAILFAST").json(root)


def log_lines(entries: DataFrame) -> DataFrame:
    """line of entries (at, level, text): levels other than the four known are info."""
    level = F.when(F.lower("level").isin("debug", "info", "warn", "error"), F.lower("level")).otherwise("info")
    return entries.select(F.concat(F.lit("["), F.col("at"), F.lit("] "), F.upper(level), F.lit(" "), T.squeezed(F.col("text"))).alias("line"))


# ---- metadata bundles ----

def enriched(scripts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scripts (path, targets) with the targets that the metadata file beside them (path of the script + -meta.xml, targets) names."""
    m = metadata.select(F.regexp_replace("path", r"-meta\.xml$", "").alias("path"), F.col("targets").alias("_t"))
    return scripts.join(m, "path", "left").withColumn("targets", F.array_union("targets", F.coalesce("_t", F.array().cast("array<string>")))).drop("_t")


def relative_path(path: Column) -> Column:
    """True for a normalised path inside its root: no empty, `.` or `..` part, no root, drive, backslash or control character."""
    return ~path.rlike(r"^/|^[A-Za-z]:|\\|[\x00-\x1f\x7f]|(^|/)\.{1,2}(/|$)|//|/$|^$")
