"""Page files and office documents to tables: frontmatter, passages, tables, resource URIs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

CONTROL_FILES = ["SCHEMA.md", "index.md", "log.md"]
TEXT_EXTENSIONS = [".md", ".txt", ".csv", ".json", ".xml", ".html", ".htm", ".rst", ".yaml", ".yml", ".log", ".tsv"]
_UNSAFE_KEYS = ["__proto__", "constructor", "prototype"]


def read(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under a folder as path (relative), raw, size, modified; dot files and folders and control files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.element_at(F.split("path", re.escape(base + "/"), 2), -1)
    return files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("raw"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").isin(CONTROL_FILES))


def header(raw: Column) -> Column:
    """Text between the frontmatter fences, or empty."""
    return F.regexp_extract(raw, r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)


def body(raw: Column) -> Column:
    return F.ltrim(F.regexp_replace(F.regexp_replace(raw, r"^---\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)", ""), r"^\s+", ""))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(value), "^[\"']", ""), "[\"']$", "")


def frontmatter(raw: Column) -> Column:
    """Map of the header's `key: value` lines; the last line of a key wins, unsafe keys are dropped."""
    lines = F.filter(F.split(header(raw), "\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: ~p["k"].isin(_UNSAFE_KEYS))
    # keep each key's last line
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def text_field(meta: Column, key: str) -> Column:
    return _unquoted(meta[key])


def list_field(meta: Column, key: str) -> Column:
    """`[a, "b"]` as an array, a plain value as an array of one, nothing as an empty one."""
    value = meta[key]
    inner = F.regexp_extract(value, r"^\[([\s\S]*)\]$", 1)
    many = F.filter(F.transform(F.split(inner, ","), _unquoted), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | (F.trim(value) == ""), none).when(value.rlike(r"^\["), many).otherwise(F.array(_unquoted(value)))


def records(files: DataFrame) -> DataFrame:
    """Pages of files (path, raw): path, title, type, tags, aliases, sources, request_id, client, project, updated, body."""
    m = files.select("path", "raw", frontmatter(F.col("raw")).alias("m"))
    field = lambda k: text_field(F.col("m"), k)
    return m.select(
        "path", F.coalesce(field("title"), "path").alias("title"), F.coalesce(field("type"), F.lit("unknown")).alias("type"),
        *(list_field(F.col("m"), k).alias(k) for k in ("tags", "aliases", "sources")),
        *(field(k).alias(k) for k in ("request_id", "client", "project", "updated")), body(F.col("raw")).alias("body"),
    )


def markdown_passages(text: str, limit: int = 1600) -> list[tuple[str, str, int]]:
    """(heading, text, first character) of a body: a heading starts a passage, so does a line that takes it over the limit."""
    out, heading, held, start, at = [], vocab.DEFAULT_HEADING, [], 0, 0

    def close():
        whole = "\n".join(held)
        if whole.strip():
            out.append((heading, whole.strip(), start))

    for line in text.split("\n"):
        bare = line.rstrip("\r")
        m = re.match(r"#{1,6}\s+(.+)$", bare)
        if m or (held and sum(len(x) + 1 for x in held) + len(bare) > limit):
            close()
            held, start = [], at
        if m:
            heading, start = m.group(1).strip(), at + len(line) + 1
        else:
            held.append(bare)
        at += len(line) + 1
    close()
    return out or [(vocab.DEFAULT_HEADING, text, 0)]


def passages(pages: DataFrame, limit: int = 1600) -> DataFrame:
    """path, pos, heading, text, char_start, passage_id of page bodies."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, i, h, t, c) for p, b in zip(part["path"], part["body"]) for i, (h, t, c) in enumerate(markdown_passages(b or "", limit))]
            yield pd.DataFrame(rows, columns=["path", "pos", "heading", "text", "char_start"])

    cut_ = pages.select("path", "body").mapInPandas(cut, "path string, pos int, heading string, text string, char_start long")
    return cut_.withColumn("passage_id", T.passage_id(F.col("heading"), F.col("text")))


def csv_markdown(content: Column, delimiter: str = ",", limit: int = 1000) -> Column:
    """Delimited text as a Markdown table: trimmed cells, blank lines dropped, first rows only (the feature's own limit), short rows padded."""
    lines = F.slice(F.filter(F.split(content, "\r?\n"), lambda x: F.trim(x) != ""), 1, limit)
    rows = F.transform(lines, lambda x: F.transform(F.split(x, re.escape(delimiter)), lambda c: F.trim(c)))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    head = F.transform(F.slice(rows, 1, 1), line)
    rule = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |")))
    rest = F.transform(F.slice(rows, 2, limit), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(head, rule, rest), "\n")).otherwise("")


def _tags(data: bytes, name: str) -> list:
    return [e for e in ElementTree.fromstring(data).iter() if e.tag.rsplit("}", 1)[-1] == name]


def xlsx_markdown(data: bytes, limit: int = 500) -> str:
    """Sheets of a workbook, cells joined by bars, `limit` rows of each (the feature's own limit)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")) for e in _tags(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        out = []
        for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            out.append(f"## {sheet.rsplit('/', 1)[-1].removesuffix('.xml')}")
            for row in _tags(z.read(sheet), "row")[:limit]:
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                out.append(" | ".join(cells))
    return "\n".join(out)


def pptx_markdown(data: bytes) -> str:
    """Slides in order, their text runs as bullets."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for i, s in enumerate(slides, 1):
            out += [f"## Slide {i}", *(f"- {t.text}" for t in _tags(z.read(s), "t") if (t.text or "").strip())]
    return "\n".join(out)


def normalized(files: DataFrame, recognize: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, markdown, problem of binary files (path, content): text as it is, tables and office files as Markdown; images and PDFs by
    the pluggable `recognize`, without one they are named as a problem."""

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"]):
                ext = "." + path.lower().rsplit(".", 1)[-1]
                try:
                    if ext in TEXT_EXTENSIONS:
                        rows.append((path, bytes(data).decode("utf-8", "replace"), None))
                    elif ext == ".xlsx":
                        rows.append((path, xlsx_markdown(bytes(data)), None))
                    elif ext == ".pptx":
                        rows.append((path, pptx_markdown(bytes(data)), None))
                    elif recognize is not None:
                        rows.append((path, recognize(bytes(data)), None))
                    else:
                        rows.append((path, None, f"no reader for {ext}"))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "problem"])

    return files.select("path", "content").mapInPandas(convert, "path string, markdown string, problem string")


def page_uri(path: Column, passage: Column | None = None) -> Column:
    """Resource URI of a page or passage; every path segment percent-coded."""
    coded = F.array_join(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.url_encode(s), r"\+", "%20")), "/")
    uri = F.concat(F.lit("page://"), coded)
    return uri if passage is None else F.concat(uri, F.lit("#"), passage)


def parsed_uri(uri: Column) -> Column:
    """Struct path, passage of a resource URI; null for another scheme, an absolute path or a step upwards."""
    path = F.url_decode(F.regexp_replace(F.regexp_extract(uri, r"^page://([^#]*)", 1), r"\+", "%2B"))
    passage = F.nullif(F.regexp_extract(uri, r"#(p-[0-9a-f]{16})$", 1), F.lit(""))
    bad = ~uri.rlike(r"^page://[^#]+(#p-[0-9a-f]{16})?$") | path.rlike(r"^/|(^|/)\.\.(/|$)|\\|\x00")
    return F.when(~bad, F.struct(path.alias("path"), passage.alias("passage")))


def resolved(uris: DataFrame, pages: DataFrame, passages_: DataFrame) -> DataFrame:
    """uri, path, text, problem of resource URIs: the page's body or the passage's text; stale passages and missing pages are named."""
    u = uris.select("uri", parsed_uri(F.col("uri")).alias("u")).select("uri", "u.path", "u.passage")
    p = u.join(pages.select("path", "body"), "path", "left").join(passages_.select("path", F.col("passage_id").alias("passage"), "text").dropDuplicates(["path", "passage"]), ["path", "passage"], "left")
    problem = F.when(F.col("path").isNull(), "invalid_uri").when(F.col("body").isNull(), "missing_page").when(F.col("passage").isNotNull() & F.col("text").isNull(), "stale_passage")
    return p.select("uri", "path", F.when(F.col("passage").isNull(), F.col("body")).otherwise(F.col("text")).alias("text"), problem.alias("problem"))
