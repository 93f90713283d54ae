"""A page under another path: the links to change, the pages after it, warnings, and probes of what a migration must not lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

#: Links as the text states them (fixed values).
NAMED = r"\[\[([^\]]+)\]\]"
LINKED = r"\[[^\]]+\]\(([^)#\s]+(?:#[^)\s]*)?)\)"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def relative(folder: Column, path: Column) -> Column:
    """The path as seen from a folder: one `..` for each part of the folder that the path doesn't share."""
    a, b = F.filter(F.split(folder, "/"), lambda x: x != ""), F.split(path, "/")
    # the file's own name isn't a shared folder
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: (i <= F.size(a)) & (i < F.size(b)) & (F.coalesce(F.slice(a, 1, i) == F.slice(b, 1, i), F.lit(False))))
    shared = F.size(F.filter(same, lambda x: x))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def _inside(folder: Column, target: Column) -> Column:
    """The path that a target means; null outside the root or on another site."""
    joined = graph._joined(folder, F.regexp_extract(target, r"^[^#]*", 0))
    return F.when(~target.rlike(r"^(https?://|#)") & ~joined.rlike(r"^\.\.(/|$)"), joined)


def link_changes(pages: DataFrame, old: str, new: str) -> DataFrame:
    """path, type (wikilink or mdlink), old_ref, new_ref: references that a move of `old` to `new` rewrites, in all pages and in
    the moved one. Names change where the file's name does; paths where it or the folder does. Each is told once per page."""
    stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md")
    before, after = stem(old), stem(new)
    folder_changes = old.rpartition("/")[0] != new.rpartition("/")[0]
    said = pages.select("path", F.coalesce("body", F.lit("")).alias("body"))
    out = None
    if before != after:
        refs = said.filter(F.col("path") != old).select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(NAMED), 1))).alias("inner"))
        name = F.trim(F.regexp_extract("inner", r"^[^|]*", 0))
        spelled = [before, before.replace("_", " "), before.replace("-", " ")]
        alias = F.regexp_extract("inner", r"^[^|]*(.*)$", 1)
        out = refs.filter(name.isin(spelled)).select("path", F.lit("wikilink").alias("type"), F.concat(F.lit("[["), "inner", F.lit("]]")).alias("old_ref"), F.concat(F.lit("[[" + after.replace("_", " ")), alias, F.lit("]]")).alias("new_ref"))
    refs = said.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LINKED), 1))).alias("target"))
    refs = refs.withColumn("meant", _inside(folder_of(F.col("path")), F.col("target"))).filter("meant IS NOT NULL")
    anchor = F.regexp_extract("target", r"#.*$", 0)
    to_it = refs.filter((F.col("path") != old) & (F.col("meant") == old)).withColumn("now", relative(folder_of(F.col("path")), F.lit(new)))
    moved = to_it
    if folder_changes:
        own = refs.filter(F.col("path") == old).withColumn("now", relative(folder_of(F.lit(new)), F.col("meant")))
        moved = moved.unionByName(own)
    moved = moved.filter(F.col("now") != F.regexp_extract("target", r"^[^#]*", 0)).select("path", F.lit("mdlink").alias("type"), F.concat(F.lit("]("), "target", F.lit(")")).alias("old_ref"), F.concat(F.lit("]("), "now", anchor, F.lit(")")).alias("new_ref"))
    return moved if out is None else out.unionByName(moved)


def moved(pages: DataFrame, old: str, new: str) -> DataFrame:
    """The pages after the move. Raises if there is no such page or its new path is taken; the pages given stay as they are, so
    a move is undone by going on with them."""
    found = {r["path"] for r in pages.filter(F.col("path").isin(old, new)).select("path").distinct().collect()}
    if old not in found:
        raise ValueError(f"{old}: there is no such page")
    if new in found:
        raise ValueError(f"{new}: there is such a page already")
    # longest first, and all at once by places: a new reference isn't taken for an old one
    c = link_changes(pages, old, new).groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.length("old_ref")).alias("k"), "old_ref", "new_ref"))).alias("_c"))
    mark = lambda i: F.concat(F.lit("\0"), i.cast("string"), F.lit("\0"))
    n = F.sequence(F.lit(1), F.size("_c"))
    hidden = F.aggregate(n, F.col("body"), lambda s, i: F.replace(s, F.element_at("_c", i)["old_ref"], mark(i)))
    body = F.aggregate(n, hidden, lambda s, i: F.replace(s, mark(i), F.element_at("_c", i)["new_ref"]))
    out = pages.join(c, "path", "left").withColumn("body", F.when(F.col("_c").isNotNull(), body).otherwise(F.col("body")))
    return out.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path"))).select(*pages.columns)


def content_warnings(pages: DataFrame, written: DataFrame) -> DataFrame:
    """path, code, detail of pages being written (path, title, body): names in brackets that no page, they included, has, and titles
    that other pages have (those pages, joined by commas)."""
    one = written.select("path", "title", "body")
    names = one.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(NAMED), 1), lambda x: F.trim(F.regexp_extract(x, r"^[^|]*", 0))))).alias("name")).filter("name <> ''")
    known = pages.select("path", "title").join(one.select("path"), "path", "left_anti").unionByName(one.select("path", "title"))
    met = graph.link_matches(known, names).select("name").distinct()
    lost = names.join(met, "name", "left_anti").select("path", F.lit("UNRESOLVED_NAME").alias("code"), F.col("name").alias("detail"))
    others = pages.select(F.col("path").alias("other"), "title")
    twice = one.select("path", "title").join(others, "title").filter("path <> other").groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("other")), ", ").alias("detail"))
    return lost.unionByName(twice.select("path", F.lit("DUPLICATE_TITLE").alias("code"), "detail"))


# ---- probes of a migration ----

def probe_queries(pages: DataFrame) -> DataFrame:
    """path, query: request, title and the first six tokens of four letters or more, at most 1,000 characters."""
    words = F.slice(F.filter(T.tokens(F.col("body")), lambda t: F.length(t) >= 4), 1, 6)
    return pages.select("path", F.substring(F.concat_ws(" ", F.when(F.col("request_id") != "", F.col("request_id")), F.substring("title", 1, 180), F.array_join(words, " ")), 1, 1000).alias("query"))


def regressions(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """what, key: what a migration lost or changed. Both sides: pages (path, sources), probes (path, recovered), edges (kind)."""

    def sizes(x):
        p = x["pages"].agg(F.count("*").alias("n")).select(F.lit("pages").alias("what"), F.lit("").alias("key"), "n")
        s = x["pages"].select(F.explode("sources").alias("s")).agg(F.countDistinct("s").alias("n")).select(F.lit("sources").alias("what"), F.lit("").alias("key"), "n")
        return p.unionByName(s).unionByName(x["edges"].groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.col("kind").alias("key"), "n"))

    changed = sizes(before).join(sizes(after).withColumnRenamed("n", "m"), ["what", "key"], "full").filter(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0)))
    lost = before["probes"].filter("recovered").join(after["probes"].filter("recovered"), "path", "left_anti")
    return changed.select("what", "key").unionByName(lost.select(F.lit("probe").alias("what"), F.col("path").alias("key")))
