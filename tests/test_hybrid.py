"""Coverage and the hybrid loop on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import coverage, graph, hybrid, lexical
from evidentia.operators.kept import root
from evidentia.operators.stores import Store


def test_entities_of_a_query():
    assert coverage.entities_of("How does the OrderService of ACME handle REQ-123?") == ["ACME", "REQ-123", "OrderService", "REQ"]
    assert coverage.entities_of("Checkout loads the cart") == []  # prose: a verb follows the first word
    assert coverage.entities_of("the project Apollo and system Beta") == []  # owners are no concepts of the query
    assert coverage.entities_of("architecture of billing/api") == []  # two plain words are no identifier
    assert coverage.entities_of(None) == []


def test_budgets_widen():
    first = hybrid.initial_budget(10)
    most = hybrid.maximum_budget(first, 10)
    assert first == hybrid.Budget(8, 60, 1, 10, 2000) and most == hybrid.Budget(32, 240, 3, 10, 4000)
    assert hybrid.level_budget(first, most, 1) == hybrid.Budget(16, 120, 2, 10, 3000)
    assert hybrid.level_budget(first, most, 2) == hybrid.level_budget(first, most, 3) == most


def _wiki(spark):
    rows = [
        ("a.md", "Invoice rules", "requirement", "R1", "Invoices are rounded to 2 digits. REQ-77 asks for it."),
        ("b.md", "Invoice code", "implementation", "R1", "The rounding module computes invoices."),
        ("c.md", "Shipping", "requirement", "R2", "Parcels leave on Monday."),
        ("d.md", "Weather", "concept", None, "Rain and wind, nothing else."),
    ]
    p = spark.createDataFrame(rows, "path string, title string, type string, request_id string, body string").withColumns({"tags": F.array(F.lit("t")), "sources": F.array(F.col("path")), "heading": F.lit("h")})
    p = p.withColumn("excerpt", T.excerpt(F.col("body")))
    edges = graph.role_edges(p)
    kinds = p.select(F.concat(F.lit("page:"), "path").alias("node"), F.lit("page").alias("kind"))
    return p, edges, kinds, lexical.LexicalIndex.create(p, f"{root(spark)}/lexical")


def test_hybrid_loop(spark):
    p, edges, kinds, index = _wiki(spark)
    q = spark.createDataFrame([(1, "rounding of invoices"), (2, "parcels and the Zeppelin on monday")], "qid long, text string")
    told = {}

    def fallback(open_, reports):
        told.update({r.qid: list(r.gaps) for r in reports.join(open_.select("qid"), "qid").collect()})
        return spark.createDataFrame([(2, "d.md", 1.0, 1)], "qid long, path string, score double, rank int")

    hits, reports = hybrid.retrieve(index, p, edges, kinds, q, k=3, fallback=fallback)
    got = {(r.qid, r.path): r for r in hits.collect()}
    level = {r.qid: r.level for r in reports.collect()}
    assert level == {1: 0, 2: 3}  # the first query is answered at once, the second never: nothing names the Zeppelin
    assert told == {2: ["entity:Zeppelin"]}
    assert {x for qid, x in got if qid == 1} >= {"a.md", "b.md"} and (2, "c.md") in got and (2, "d.md") in got
    end = {r.qid: r for r in reports.collect()}
    assert end[1].sufficient and list(end[2].gaps) == ["entity:Zeppelin"]


def test_exact_name_goes_first(spark):
    p, edges, kinds, index = _wiki(spark)
    q = spark.createDataFrame([(1, "REQ-77")], "qid long, text string")
    sem = spark.createDataFrame([(1, f, i + 1) for i, f in enumerate(["d.md", "c.md", "b.md"])], "qid long, path string, rank int")
    hits, _ = hybrid.retrieve(index, p, edges, kinds, q, sem, k=3, max_level=0)
    assert [r.path for r in hits.orderBy("rank").collect()][0] == "a.md"


def test_store_refuses_what_breaks_a_rule(spark):
    store = Store(spark, f"{root(spark)}/store")
    assert store.version() == 0
    t = spark.createDataFrame([(1,), (2,)], "x long")
    assert store.write({"t": t}) == 1
    with pytest.raises(ValueError, match="even"):
        store.write({"t": t}, {"even": t.filter("x % 2 = 0")})
    assert store.version() == 1 and store.write({"t": store.read("t").filter("x = 1")}, {"none": t.limit(0)}) == 2
    assert [r.x for r in store.read("t").collect()] == [1]


def test_levels_share_the_graph(spark, monkeypatch):
    p, edges, kinds, index = _wiki(spark)
    made, own = [], graph.adjacency
    monkeypatch.setattr(graph, "adjacency", lambda e: made.append(1) or own(e))
    q = spark.createDataFrame([(1, "parcels and the Zeppelin on monday")], "qid long, text string")
    hybrid.retrieve(index, p, edges, kinds, q, k=3)
    assert len(made) == 1  # the query is open at every level
