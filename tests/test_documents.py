"""Sections, plans and packs of documents."""

from evidentia.operators import documents, governance

DOC = "intro\n## One\ntext one\n```\n## not a heading\n```\n## Two (optional)\n[link](x.md) *bold*\n## Three\n"


def test_sections(spark):
    docs = spark.createDataFrame([("d", DOC), ("e", "plain"), ("f", "")], "path string, body string")
    got = {(r.path, r.place): (r.title, r.text) for r in documents.sections(docs).collect()}
    assert got == {("d", 0): ("", "intro"), ("d", 1): ("One", "text one\n```\n## not a heading\n```"), ("d", 2): ("Two (optional)", "[link](x.md) *bold*"), ("d", 3): ("Three", ""), ("e", 0): ("", "plain")}
    assert [(r.title, r.required) for r in documents.template_sections(docs).orderBy("place").collect()] == [("One", True), ("Two", False), ("Three", True)]
    assert {r.title: r.chars for r in documents.sufficiency(docs, 5).collect()} == {"One": 8, "Two (optional)": 9, "Three": 0}
    drafts = documents.report_drafts(docs, {"one": "implementation", "three": "decision"}).collect()
    assert [(r.type, r.title) for r in drafts] == [("implementation", "One")]
    hits = spark.createDataFrame([(1, "p", 1), (1, "q", 9)], "qid long, path string, rank int")
    assert [(r.place, r.path) for r in documents.plan(docs, hits).orderBy("place").collect()] == [(1, "p"), (2, None), (3, None)]


def test_packs(spark):
    p = spark.createDataFrame([(1, "a", 0, 0.5, "x" * 30), (1, "a", 1, 0.9, "y" * 50), (1, "a", 2, 0.1, "z" * 40), (2, "b", 0, 1.0, "w" * 200)], "qid long, path string, pos int, score double, text string")
    got = documents.packed_passages(p, 90)
    assert [(r.qid, r.pos) for r in got.collect()] == [(1, 0), (1, 1)]
    assert {r.qid: r.state for r in documents.covered_sections(got, spark.createDataFrame([(1,), (2,)], "qid long")).collect()} == {1: "COVERED", 2: "GAP"}


def test_review_and_summary(spark):
    docs = spark.createDataFrame([("bad", "# A\n# B\n<script>x</script> [l](javascript:x) TODO\n```\n"), ("good", "# A\n\n## Scope\n" + "text " * 20)], "path string, body string")
    got = {(r.path, r.code) for r in governance.review(docs, ["Scope"]).collect()}
    assert got == {("bad", c) for c in ("RAW_HTML_UNSAFE", "LINK_UNSAFE_URI", "UNRESOLVED_PLACEHOLDER", "DOCUMENT_TITLE_CONTRACT", "DOCUMENT_SECTION_CONTRACT", "UNCLOSED_CODE_FENCE", "MISSING_SECTIONS")}
    nodes = spark.createDataFrame([("a", "page"), ("b", "tag")], "id string, kind string")
    edges = spark.createDataFrame([("a", "has_tag", "b")], "src string, kind string, dst string")
    assert [r.line for r in documents.graph_summary(nodes, edges).collect()] == ["- page: 1", "- tag: 1", "- a --has_tag--> b"]
