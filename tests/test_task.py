"""The semantic index, moves and gaps on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import assets, moves, semantic, task
from evidentia.operators.kept import root
from evidentia.plans.task_plans import hashed

PASSAGES = "path string, pos int, passage_id string, heading string, text string"


def _index(spark, at, name="hashed-words"):
    return semantic.SemanticIndex(spark, at, hashed, 32, name)


def test_semantic_index(spark):
    at = f"{root(spark)}/semantic"
    index = _index(spark, at)
    assert index.pages().count() == 0 and index.passages().count() == 0
    rows = [("a", 0, "1", None, "red apples"), ("a", 1, "2", "h", "green pears"), ("b", 0, "1", None, "blue sky"), ("c", 0, "1", None, None)]
    assert index.synchronize(spark.createDataFrame(rows, PASSAGES)) == {"reused": 0, "embedded": 3, "removed": 0, "passages": 4}
    rows[2] = ("b", 0, "1", None, "grey sky")
    assert index.synchronize(spark.createDataFrame(rows[:3], PASSAGES)) == {"reused": 1, "embedded": 1, "removed": 1, "passages": 1}
    assert index.synchronize(spark.createDataFrame(rows[:3], PASSAGES)) == {"reused": 2, "embedded": 0, "removed": 0, "passages": 0}
    ask = spark.createDataFrame([(1, " grey  sky"), (2, "green pears"), (3, "blue sky")], "qid long, text string")
    hit = lambda ix: {(r.qid, r.path, r.text) for r in ix.search(ask, k=1, minimum=0.99).collect()}
    assert hit(index) == {(1, "b", "grey sky"), (2, "a", "green pears")}  # the old text of b is gone
    index.upsert(spark.createDataFrame([("d", 0, "1", None, "blue sky")], PASSAGES))
    index.remove(spark.createDataFrame([("a",), ("x",)], "path string"))
    index.compact()
    assert hit(_index(spark, at)) == {(1, "b", "grey sky"), (3, "d", "blue sky")}
    index.remove(index.pages())
    assert index.search(ask).count() == 0
    with pytest.raises(ValueError, match="was made by"):
        _index(spark, at, "another")
    for text in ("  ", "x" * 4097, None):
        with pytest.raises(ValueError, match="characters"):
            index.search(spark.createDataFrame([(1, text)], "qid long, text string"))
    with pytest.raises(ValueError, match="k must"):
        index.search(ask, k=0)


def test_provider_is_checked(spark):
    p = spark.createDataFrame([("a", 0, "1", None, "x")], PASSAGES)
    for bad in (lambda t: [], lambda t: [[1.0]], lambda t: [[float("nan")] * 4]):
        with pytest.raises(Exception, match="invalid result"):
            semantic.embedded(p, bad, 4).collect()


def test_relative_paths(spark):
    cases = [("", "a.md", "a.md"), ("x", "a.md", "../a.md"), ("x/y", "x/a.md", "../a.md"), ("x", "x/y/a.md", "y/a.md"), ("a", "a", "../a"), ("x/y/z", "x/q/a.md", "../../q/a.md")]
    got = spark.createDataFrame(cases, "f string, p string, want string").select("want", moves.relative(F.col("f"), F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [c[2] for c in cases]


def test_moves(spark):
    rows = [
        ("old/my_page.md", "My page", "[a](other.md#x) [me](my_page.md) [out](https://x.org/my_page.md) [up](../../no.md)"),
        ("old/other.md", "Other", "[p](my_page.md#here) [[my_page]] [[my page|that]] [[my pages]] [q](./my_page.md)"),
        ("top.md", "Top", "[p](old/my_page.md) [p](old/my_page.md) ![i](#my_page)"), ("null.md", "Null", None),
    ]
    p = spark.createDataFrame(rows, "path string, title string, body string")
    got = {r.path: r.body for r in moves.moved(p, "old/my_page.md", "new_page.md").collect()}
    assert got == {
        "new_page.md": "[a](old/other.md#x) [me](old/my_page.md) [out](https://x.org/my_page.md) [up](../../no.md)",
        "old/other.md": "[p](../new_page.md#here) [[new page]] [[new page|that]] [[my pages]] [q](../new_page.md)",
        "top.md": "[p](new_page.md) [p](new_page.md) ![i](#my_page)", "null.md": None,
    }
    for old, new, why in (("none.md", "x.md", "no such page"), ("top.md", "null.md", "already")):
        with pytest.raises(ValueError, match=why):
            moves.moved(p, old, new)
    assert moves.link_changes(p, "top.md", "top.md").count() == 0


def test_gaps_of_an_empty_task(spark):
    q = spark.createDataFrame([(1, "document", [], 0, 100), (2, "nothing known", [], 0, 100)], "qid long, intent string, requested array<string>, omitted long, budget long")
    h = spark.createDataFrame([], "qid long, path string, rank int, request_id string, body string, tags array<string>, sources array<string>, categories array<string>, shown boolean")
    h = task.with_drift(task.with_contradictions(h), spark.createDataFrame([], "path string, claim_id string, reason string"))
    assert {(r.qid, r.kind, r.description) for r in task.gaps(q, h).collect()} == {(1, "missing_evidence", "No requirements was recovered for intent document."), (1, "missing_evidence", "No source provenance was recovered for the document task.")}
    assert task.impact(q, h, spark.createDataFrame([], "src string, dst string")).count() == 0


def test_assets_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(bytes.fromhex(assets.PNG) + b"x")
    (tmp_path / "plain").write_text("\ufeff<svg><script/></svg>")
    got = assets.read(spark, str(tmp_path))
    assert {(r.asset, r["size"], r.text is None) for r in got.collect()} == {("sub/a.png", 9, True), ("plain", 23, False)}
    docs = spark.createDataFrame([("d", "![a](../assets/sub/a.png) <img alt=x src='../assets/plain'> ![b](../assets/sub/a.png)"), ("e", None)], "path string, body string")
    assert {(r.code, r.target) for r in assets.findings(docs, got).collect()} == {("ASSET_TYPE_UNSUPPORTED", "../assets/plain"), ("SVG_ACTIVE_CONTENT", "../assets/plain")}
