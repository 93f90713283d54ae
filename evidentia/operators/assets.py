"""Checks of the images that documents link to: address, path, size, signature, active SVG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import _joined

MAX_BYTES = 5 << 20
#: Schemes that an image must not have, besides the engine's own; what a portable path begins with; the first bytes of a PNG. (Fixed values.)
UNSAFE = ["javascript", "vbscript", "data", "file"]
FOLDER = "../assets/"
PNG = "89504E470D0A1A0A"
IMAGE = r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"
IMAGE_TAG = r"(?i)<img\b[^>]*?\ssrc\s*=\s*[\"']?([^\"'\s>]+)"
#: An SVG's beginning, and what makes it active. (Fixed values.)
SVG = r"(?i)^\uFEFF?\s*(?:<\?xml[^>]*>\s*)?<svg(?![A-Za-z0-9_])"
ACTIVE = r"(?i)<!DOCTYPE|<!ENTITY|<script(?![A-Za-z0-9_])|<foreignObject(?![A-Za-z0-9_])|<(?:iframe|object|embed)(?![A-Za-z0-9_])|\son[a-z]+\s*=|@import|url\s*\("
REFERENCE = r"(?i)(?<![A-Za-z0-9_])(?:href|src|action|formaction)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))"


def unescaped(text: Column) -> Column:
    """ASCII characters written as numbers or as colon, tab and newline by name; others stay."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#[0-9]{1,7};?|&#x[0-9a-f]{1,6};?|&(?:colon|tab|newline);"), 0)), lambda a, b: F.length(b) - F.length(a))

    def plain(e: Column) -> Column:
        name = F.lower(F.regexp_replace(e, "[&;]", ""))
        code = F.when(name == "colon", 58).when(name == "tab", 9).when(name == "newline", 10).when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10).cast("long")).otherwise(F.substring(name, 2, 8).try_cast("long"))
        return F.when(code.between(1, 127), F.char(code)).otherwise(e)

    return F.aggregate(found, text, lambda s, e: F.replace(s, e, plain(e)))


def normalized_uri(uri: Column) -> Column:
    return F.lower(F.regexp_replace(unescaped(uri), r"[\x00-\x20\x7f]+", ""))


def active(svg: Column, own_scheme: str = "evidentia") -> Column:
    """True for an SVG with scripts, handlers, foreign content or references to elsewhere."""
    decoded = unescaped(svg)
    uris = F.transform(F.regexp_extract_all(decoded, F.lit(REFERENCE), 0), lambda m: normalized_uri(F.regexp_replace(m, r"^[^=]*=\s*[\"']?|[\"']$", "")))
    return decoded.rlike(ACTIVE) | F.exists(uris, lambda u: u.rlike(rf"^(//|https?:|(?:{'|'.join([*UNSAFE, own_scheme])}):)"))


def images(docs: DataFrame) -> DataFrame:
    """path, target: the images of documents (path, body), each once."""
    found = F.concat(F.regexp_extract_all("body", F.lit(IMAGE), 1), F.regexp_extract_all("body", F.lit(IMAGE_TAG), 1))
    return docs.select("path", F.explode(F.array_distinct(found)).alias("target"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """asset (path below the folder), size, head (first bytes as hexadecimal), text (of an SVG or a file without extension that isn't too large)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    asset = F.expr("substring_index(path, '" + base.replace("'", "''") + "', -1)")
    wanted = F.lower(asset).rlike(r"\.svg$|(^|/)[^./]+$") & (F.col("length") <= MAX_BYTES)
    return found.select(asset.alias("asset"), F.col("length").alias("size"), F.hex(F.substring("content", 1, 8)).alias("head"), F.when(wanted, F.decode("content", "UTF-8")).alias("text"))


def findings(docs: DataFrame, assets: DataFrame, own_scheme: str = "evidentia") -> DataFrame:
    """path, severity, code, target of the images of documents (path, body); assets as `read` gives them."""
    i = images(docs)
    uri = normalized_uri(F.col("target"))
    scheme = F.regexp_extract(uri, r"^([a-z][a-z0-9+.-]*):", 1)
    named = F.try_url_decode(F.replace(F.regexp_extract("target", r"^[^?#]*", 0), F.lit("+"), F.lit("%2B")))
    i = i.withColumns({"scheme": scheme, "named": named}).withColumn("inside", F.when((F.col("scheme") == "") & F.col("named").startswith(FOLDER), _joined(F.lit(""), F.substring("named", len(FOLDER) + 1, 1 << 30))))
    i = i.withColumn("ext", F.lower(F.regexp_extract("inside", r"(?:[^/])(\.[^./]*)$", 1))).join(assets.withColumnRenamed("asset", "inside"), "inside", "left")
    c, ext = F.col, F.col("ext")
    checked = ext.isin(".svg", ".png")
    firm = checked | (ext == "")
    entry = lambda severity, code: F.struct(severity.alias("severity"), F.lit(code).alias("code"))
    block, warn = F.lit("BLOCKER"), F.lit("WARNING")
    held = F.when(firm, "BLOCKER").otherwise("WARNING")
    state = (
        F.when(c("inside").rlike(r"^\.\.(/|$)"), entry(block, "ASSET_PATH_ESCAPE")).when(c("inside") == "", entry(block, "ASSET_PATH_INVALID")).when(c("size").isNull(), entry(held, "ASSET_MISSING")).when(c("size") > MAX_BYTES, entry(held, "ASSET_TOO_LARGE"))
        .when((ext == ".png") & (c("head") != PNG), entry(block, "ASSET_SIGNATURE_INVALID")).when((ext == ".svg") & ~c("text").rlike(SVG), entry(block, "ASSET_SIGNATURE_INVALID"))
        .when(ext.isin(".svg", "") & c("text").rlike(SVG) & active(c("text"), own_scheme), entry(block, "SVG_ACTIVE_CONTENT"))
    )
    local = F.array_compact(F.array(F.when(~checked, entry(warn, "ASSET_TYPE_UNSUPPORTED")), state))
    found = (
        F.when(c("scheme").isin("http", "https"), F.array(entry(warn, "ASSET_REMOTE"))).when(c("scheme").isin(*UNSAFE, own_scheme), F.array(entry(block, "ASSET_UNSAFE_URI")))
        .when((c("scheme") != "") | c("target").startswith("#"), F.array(entry(warn, "ASSET_NON_PORTABLE"))).when(c("target").contains("\\"), F.array(entry(block, "ASSET_PATH_INVALID")))
        .when(c("inside").isNull(), F.array(entry(block, "ASSET_PATH_INVALID"))).otherwise(local)
    )
    return i.select("path", "target", F.explode(found).alias("f")).select("path", "f.severity", "f.code", "target")
