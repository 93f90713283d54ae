"""The workspace calls over a small wiki."""

import pytest
from pyspark.sql import functions as F

from evidentia.api import Workspace
from evidentia.operators import evidence
from evidentia.functions import text as T

WIKI = {
    "requirements/pay.md": "---\ntitle: Pay orders\ntype: requirement\ntags: [pay]\nsources: [spec.pdf]\nrequest_id: REQ-1\n---\nOrders must never be paid twice. [[Shop service]]",
    "implementations/shop.md": "---\ntitle: Shop service\ntype: implementation\ntags: [shop]\nsources: [spec.pdf]\nrequest_id: REQ-1\n---\nThe shop service pays orders. [gone](missing.md)",
    "tests/pay.md": "---\ntitle: Pay test\ntype: test_result\ntags: [test]\nsources: [run.txt]\nrequest_id: REQ-1\n---\nVerified.",
    "notes.md": "no header",
}


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wiki")
    for path, raw in WIKI.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(raw)
    (root / "code").mkdir()
    (root / "code/shop.py").write_text("def pay(order):\n    return charge(order)\n")
    return Workspace.open(spark, str(root), str(root / "code"))


def test_context(wiki):
    assert [r.path for r in wiki.search("pay orders twice").collect()][0] == "requirements/pay.md"
    assert wiki.search(" ").count() == 4
    nodes = {r.node for r in wiki.subgraph("twice").collect()}
    assert {"page:requirements/pay.md", "page:implementations/shop.md", "page:tests/pay.md"} <= nodes
    got = wiki.task("paid twice", "implement").orderBy("place").collect()
    assert got[0].path == "requirements/pay.md" and "invariants" in got[0].categories and {r.path for r in got} >= {"implementations/shop.md", "tests/pay.md"}
    assert {r.missing for r in wiki.traceability().collect()} == {"request,release"}


def test_pages(wiki):
    assert wiki.delete("notes.md").list().count() == 3
    with pytest.raises(ValueError):
        wiki.edit("notes.md", "absent", "x")
    assert "yes header" in [r.body for r in wiki.edit("notes.md", "no header", "yes header").pages.collect()]
    moved = wiki.move("implementations/shop.md", "implementations/store.md")
    assert "implementations/store.md" in [r.path for r in moved.pages.collect()]
    new = wiki.pages.filter("path = 'notes.md'").withColumn("body", F.lit("new"))
    assert wiki.write(new).pages.filter("body = 'new'").count() == 1
    codes = {(r.code, r.path) for r in wiki.lint().collect()}
    assert ("BROKEN_LINK", "implementations/shop.md") in codes and ("INVALID_TYPE", "notes.md") in codes and ("ORPHAN", "notes.md") in codes and ("ORPHAN", "implementations/shop.md") not in codes


def test_ingest_and_code(spark, wiki):
    s = wiki.segments(spark.createDataFrame([("src", "# A\ntext\n# B\nmore\n")], "source_uri string, content string")).withColumn("status", F.when(F.col("seq") == 0, "skipped").otherwise("pending"))
    assert wiki.next_segment(s).first().seq == 1 and wiki.source_status(s).first().state == "open"
    assert wiki.code_search("pay").first().symbol == "pay" and wiki.code_symbol("pay").first().score == 200
    assert [r.how for r in wiki.code_references("charge").collect()].count("call") >= 1
    f = wiki.files.select("path", "content")
    anchors = f.select(F.lit(1).alias("anchor_id"), "path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), T.range_hash(F.col("content"), F.lit(1), F.lit(2)).alias("range_hash"), F.lit("v0").alias("parser_version"))
    assert wiki.drift(anchors).first().reason == "parser_version_changed"
    c = spark.createDataFrame([("c1", "requirement", "Same text", "pay orders"), ("c2", "requirement", "Same  text", "x"), ("c3", "fact", "other", "nothing")], "claim_id string, kind string, text string, anchor string")
    r = spark.createDataFrame([("c3", "contradicts", "c1")], "claim_id string, type string, target_id string")
    got = {x.claim_id: (x.disposition, x.status) for x in wiki.apply_claims(c, r).collect()}
    assert got["c2"][0] == "duplicate" and got["c3"] == ("contradiction", "contradicted") and got["c1"] == ("candidate_update", "contradicted")
    assert wiki.manifest().count() == 4 and evidence.corpus_digest(wiki.manifest()).count() == 1
