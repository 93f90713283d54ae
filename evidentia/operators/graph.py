"""Typed property graph: build, degrees, link resolution, bounded expansion from seeds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from .kept import kept


def _typed(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), T.slug(value))


def _page(path: Column) -> Column:
    return F.concat(F.lit("page:"), path)


def _exploded(pages: DataFrame, column: str) -> DataFrame:
    return pages.select("path", F.explode(column).alias("v")).filter("v IS NOT NULL")


def nodes(pages: DataFrame) -> DataFrame:
    """id, kind, label: pages and the source, tag, client, project and request nodes they name. Of equal ids the smallest label stays."""
    out = pages.select(_page(F.col("path")).alias("id"), F.lit("page").alias("kind"), F.col("title").alias("label"))
    for kind, column in (("source", "sources"), ("tag", "tags")):
        out = out.unionByName(_exploded(pages, column).select(_typed(kind, F.col("v")).alias("id"), F.lit(kind).alias("kind"), F.col("v").alias("label")))
    for kind, column in (("client", "client"), ("project", "project"), ("request", "request_id")):
        if column in pages.columns:
            out = out.unionByName(pages.filter(F.col(column).isNotNull()).select(_typed(kind, F.col(column)).alias("id"), F.lit(kind).alias("kind"), F.col(column).alias("label")))
    return out.groupBy("id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"))


def metadata_edges(pages: DataFrame) -> DataFrame:
    """src, kind, dst from the pages' own fields."""
    parts = []
    for kind, node, column in (("derived_from", "source", "sources"), ("has_tag", "tag", "tags")):
        parts.append(_exploded(pages, column).select(_page(F.col("path")).alias("src"), F.lit(kind).alias("kind"), _typed(node, F.col("v")).alias("dst")))
    for kind, node, column in (("belongs_to_client", "client", "client"), ("belongs_to_project", "project", "project"), ("same_request", "request", "request_id")):
        if column in pages.columns:
            parts.append(pages.filter(F.col(column).isNotNull()).select(_page(F.col("path")).alias("src"), F.lit(kind).alias("kind"), _typed(node, F.col(column)).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["src", "kind", "dst"])


#: (kind of edge, types it leaves, types it enters) among the pages of one request.
ROLES = [("implements", ["request", "requirement"], ["implementation"]), ("tests", ["requirement", "implementation"], ["test_result"]), ("released_by", ["request", "implementation"], ["release"])]


def role_edges(pages: DataFrame) -> DataFrame:
    """Edges between the typed pages of a request: an equi-join on the request, typed on both sides."""
    p = pages.filter("request_id IS NOT NULL").select("request_id", "type", _page(F.col("path")).alias("node"))
    out = None
    for kind, left, right in ROLES:
        a, b = p.filter(F.col("type").isin(left)), p.filter(F.col("type").isin(right)).select("request_id", F.col("node").alias("dst"))
        e = a.join(b, "request_id").filter("node <> dst").select(F.col("node").alias("src"), F.lit(kind).alias("kind"), "dst")
        out = e if out is None else out.unionByName(e)
    return out


def _joined(folder: Column, target: Column) -> Column:
    """The path that a target names as seen from a folder: joined, `.` and `..` worked off."""
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda x: (x != "") & (x != "."))
    step = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _named(pages: DataFrame) -> DataFrame:
    """key, path: every name under which a page's file can be meant (each tail of its path, in lower case)."""
    parts = F.split(F.lower("path"), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return pages.select("path", F.explode(tails).alias("key"))


def _spellings(target: Column) -> Column:
    return F.transform(F.array_distinct(F.array(target, F.replace(target, F.lit(" "), F.lit("_")), F.replace(target, F.lit(" "), F.lit("-")))), lambda x: F.lower(F.concat(x, F.lit(".md"))))


def resolved_links(pages: DataFrame) -> DataFrame:
    """path, target, resolved (null if none). A target in .md is a path, seen from the linking page's folder; any other is a
    title (the last page of a title wins), else a file name, with blanks as written, `_` or `-` (the first path wins)."""
    links = pages.select("path", F.explode(T.wiki_links(F.col("body"))).alias("target")).withColumn("_t", F.regexp_replace("target", r"\\", "/"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = links.filter(F.col("_t").endswith(".md")).withColumn("resolved", _joined(folder, F.col("_t")))
    files = files.join(pages.select(F.col("path").alias("resolved"), F.lit(True).alias("_there")), "resolved", "left").select("path", "target", F.when(F.col("_there"), F.col("resolved")).alias("resolved"))
    titles = pages.groupBy(F.lower("title").alias("_key")).agg(F.max("path").alias("by_title"))
    first = _named(pages).groupBy("key").agg(F.min("path").alias("by_file"))
    names = links.filter(~F.col("_t").endswith(".md")).join(titles, F.lower("_t") == titles["_key"], "left")
    names = names.withColumn("key", F.explode(_spellings(F.col("_t")))).join(first, "key", "left").groupBy("path", "target").agg(F.first("by_title").alias("by_title"), F.min("by_file").alias("by_file"))
    return files.unionByName(names.select("path", "target", F.coalesce("by_title", "by_file").alias("resolved")))


def link_matches(pages: DataFrame, names: DataFrame) -> DataFrame:
    """name, path: all pages that a name (column name) can mean, by title or by file name."""
    n = names.select("name").distinct()
    titled = pages.select(F.lower(F.trim("title")).alias("key"), "path")
    by_title = n.withColumn("key", F.lower(F.trim("name"))).join(titled, "key").select("name", "path")
    by_file = n.withColumn("key", F.explode(_spellings(F.col("name")))).join(_named(pages), "key").select("name", "path")
    return by_title.unionByName(by_file).distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """edges with the weight of their kind."""
    pairs = [x for k, w in vocab.EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]
    return edges.withColumn("weight", F.element_at(F.create_map(*pairs), F.col("kind")))


def _both_ways(edges: DataFrame) -> DataFrame:
    e = weighted(edges)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "kind", "weight").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "kind", "weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbor, kind, weight in both directions, the best weight of a pair and kind."""
    return _both_ways(edges).groupBy("node", "neighbor", "kind").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edge ends at a node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes (column node)."""
    keep = chosen.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def expand(edges: DataFrame, kinds: DataFrame, seeds: DataFrame, *, max_nodes: int = 12, depth: int = 1, beam: int | None = None, max_visited: int | None = None) -> DataFrame:
    """qid, node, rank (value), place: beam expansion of many seed sets (qid, node, score) at once.

    Set-wise form for graphs without request nodes (kinds: node, kind), where it gives what visiting one node
    after the other gives. A hop is one join with the adjacency; its width is bounded by the beam. What the last hop finds needn't be
    remembered, so of a node's neighbours only its best are asked: as many as the beam takes and as a query has seen before. (A hop
    before the last meets all neighbours, since all count as seen.)
    """
    beam = beam or max(max_nodes, 8)
    max_visited = max(max_nodes, max_visited or max(4 * max_nodes, 32))
    near = _both_ways(edges).groupBy("node", "neighbor").agg(F.max("weight").alias("weight"))
    near = near.join(degrees(edges).select(F.col("node").alias("neighbor"), (1 / F.log2(2 + F.col("degree"))).alias("hub")), "neighbor").select("node", "neighbor", (F.col("weight") * vocab.HOP_DECAY * F.col("hub")).alias("factor"))
    near = kept(near) if depth > 1 else near
    frontier = seeds.groupBy("qid", "node").agg(F.max("score").alias("value"))
    seen, visited = frontier.select("qid", "node"), None
    for hop in range(depth + 1):
        order = W.partitionBy("qid").orderBy(F.desc("value"), "node")
        current = frontier.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= beam)
        if visited is not None:
            used = visited.groupBy("qid").agg(F.count("*").alias("used"))
            current = current.join(used, "qid", "left").filter(F.col("rn") + F.coalesce("used", F.lit(0)) <= max_visited).drop("used")
        else:
            current = current.filter(F.col("rn") <= max_visited)
        visited = current.select("qid", "node", "value") if visited is None else visited.unionByName(current.select("qid", "node", "value"))
        if hop == depth:
            break
        open_ = current.join(kinds.filter(~F.col("kind").isin(vocab.HUB_KINDS)).select("node"), "node", "left_semi")
        if hop == depth - 1:
            most = beam + (seen.groupBy("qid").count().agg(F.max("count")).first()[0] or 0)
            near = near.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy(F.desc("factor"), "neighbor"))).filter(F.col("rn") <= most).drop("rn")
        reached = open_.drop("rn").join(near, "node").select("qid", F.col("neighbor").alias("node"), (F.col("value") * F.col("factor")).alias("value"))
        frontier = reached.join(seen, ["qid", "node"], "left_anti").groupBy("qid", "node").agg(F.max("value").alias("value"))
        if hop < depth - 1:
            frontier = kept(frontier)
            seen = seen.unionByName(frontier.select("qid", "node"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("value"), "node"))
    return visited.withColumn("place", place).filter(F.col("place") <= max_nodes)


def _walk(adj: dict, kind: dict, degree: dict, seeds: dict, max_nodes: int, depth: int, beam: int, max_visited: int) -> list[tuple]:
    """One query, node after node; request nodes pass their siblings on within the same hop."""
    rank, best, visited = dict(seeds), dict.fromkeys(seeds, 0), {}
    frontier = [(n, v, 0) for n, v in seeds.items()]
    hub = lambda n: 1 / math.log2(2 + degree.get(n, 0))
    while frontier and len(visited) < max_visited:
        frontier.sort(key=lambda x: (-x[1], x[0]))
        following: dict = {}
        for node, value, at in frontier[:beam]:
            if len(visited) >= max_visited:
                break
            if node in visited:
                continue
            visited[node] = True
            if at >= depth or kind.get(node) in vocab.HUB_KINDS:
                continue
            for other, weight in adj.get(node, ()):
                if other in visited:
                    continue
                passed = value * weight * vocab.HOP_DECAY * hub(other)
                if passed <= 0 or best.get(other, math.inf) < at + 1:
                    continue
                best[other] = at + 1
                rank[other] = max(rank.get(other, 0), passed)
                if other not in following or passed > following[other][0]:
                    following[other] = (passed, at + 1)
                if kind.get(other) == "request":
                    for sibling, w in adj.get(other, ()):
                        if sibling == node or sibling in visited:
                            continue
                        shared = passed * w * hub(sibling)
                        rank[sibling] = max(rank.get(sibling, 0), shared)
                        if sibling not in following or shared > following[sibling][0]:
                            best[sibling] = at + 1
                            following[sibling] = (shared, at + 1)
        frontier = [(n, v, a) for n, (v, a) in following.items()]
    return sorted(((n, rank.get(n, 0)) for n in visited), key=lambda x: (-x[1], x[0]))[:max_nodes]


def walkable(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """node, neighbor, kind, weight, node_kind, other_kind, degree of nodes that are no hubs, kept: what `expand_exact` walks on. The
    walks of a graph share it."""
    adj = adjacency(edges).join(kinds.withColumnRenamed("kind", "node_kind"), "node").filter(~F.col("node_kind").isin(vocab.HUB_KINDS))
    return kept(adj.join(kinds.select(F.col("node").alias("neighbor"), F.col("kind").alias("other_kind")), "neighbor").join(degrees(edges).select(F.col("node").alias("neighbor"), "degree"), "neighbor"))


def expand_exact(edges: DataFrame, kinds: DataFrame, seeds: DataFrame, *, adj: DataFrame | None = None, max_nodes: int = 12, depth: int = 1, beam: int | None = None, max_visited: int | None = None) -> DataFrame:
    """As `expand`, for graphs with request nodes: the neighbourhood of each query is gathered set-wise, hubs'
    own edges left out, then walked node after node, one query per group. `adj`: `walkable` of the graph, if it is there."""
    beam = beam or max(max_nodes, 8)
    max_visited = max(max_nodes, max_visited or max(4 * max_nodes, 32))
    # hop by hop from what the last hop has found; each hop is kept, so that the next ones don't repeat it
    adj = walkable(edges, kinds) if adj is None else adj
    reach = last = seeds.select("qid", "node").distinct()
    for _ in range(2 * depth):
        last = kept(last.join(adj, "node").select("qid", F.col("neighbor").alias("node")).distinct().join(reach, ["qid", "node"], "left_anti"))
        reach = reach.unionByName(last)
    local = reach.join(adj, "node").select("qid", "node", "node_kind", "neighbor", "other_kind", "degree", "kind", "weight", F.lit(None).cast("double").alias("score"))
    start = kinds.join(F.broadcast(seeds), "node", "right").select("qid", "node", F.col("kind").alias("node_kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("neighbor", "string"), ("other_kind", "string"), ("degree", "long"), ("kind", "string"), ("weight", "double"))), F.col("score").cast("double").alias("score"))

    def walk(key, part: pd.DataFrame) -> pd.DataFrame:
        first = part[part["score"].notna()]
        links = part[part["score"].isna()].sort_values(["weight", "kind", "neighbor"], ascending=[False, True, True])
        near: dict = {}
        for n, m, w in zip(links["node"], links["neighbor"], links["weight"]):
            near.setdefault(n, []).append((m, w))
        kind = dict(zip(links["neighbor"], links["other_kind"])) | dict(zip(part["node"], part["node_kind"]))
        out = _walk(near, kind, dict(zip(links["neighbor"], links["degree"])), dict(zip(first["node"], first["score"])), max_nodes, depth, beam, max_visited)
        return pd.DataFrame({"qid": [key[0]] * len(out), "node": [n for n, _ in out], "value": [float(v) for _, v in out], "place": range(1, len(out) + 1)})

    return local.unionByName(start).groupBy("qid").applyInPandas(walk, "qid long, node string, value double, place int")


def search_nodes(nodes_: DataFrame, terms: list[str], limit: int = 6) -> DataFrame:
    """Diagnostic keyword scoring of all nodes: per term, 2 for a page (1 otherwise) that holds it, 4 more in the label."""
    held = lambda t: F.when(F.instr(F.lower("id"), t) > 0, F.when(F.col("kind") == "page", 2).otherwise(1)).otherwise(0)
    score = sum((held(t) + F.when(F.instr(F.lower("label"), t) > 0, 4).otherwise(0) for t in terms), F.lit(0))
    return nodes_.select("id", "kind", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)
