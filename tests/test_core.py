"""Text functions, sources, operators on small inputs with known results."""

import io
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import code, context, evidence, fusion, graph, lexical, metrics, vector
from evidentia.sources import code as code_files
from evidentia.sources import pages as page_files
from evidentia.streaming import incremental


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_tokens(spark):
    got = one(spark, T.distinct_tokens(F.col("t")), t="REQ-123 aggiorna Asset__c via /services/data/v1 req-123")
    assert got == ["req-123", "req", "123", "aggiorna", "asset__c", "asset", "via", "/services/data/v1", "services", "data", "v1"]
    assert one(spark, T.search_text(F.col("t"), nfkc=True), t="Ｆｕｌｌ  width, (x)") == "full width x"
    assert one(spark, T.slug(F.col("t")), t="Perché no?") == "Perche_no" and one(spark, T.slug(F.col("t")), t="--") == "item"
    assert [one(spark, T.stem(F.col("t")), t=w) for w in ("queries", "testing", "tests", "req-1s", "cat", "utilizzare")] == ["query", "test", "test", "req-1s", "cat", "utilizz"]
    assert set(one(spark, T.identifier_aliases(F.col("t")), t="Work Item x1")) == {"work", "item", "x1", "workitem", "itemx1", "workitemx1"}
    assert one(spark, T.estimated_tokens(F.col("t")), t="àbc") == 2


def test_range_hash_ignores_trailing_blanks(spark):
    h = lambda t, a, b: one(spark, T.range_hash(F.col("t"), F.lit(a), F.lit(b)), t=t)
    assert h("a\nb\nc", 1, 2) == h("a \t\r\nb\nz", 1, 2) != h("a\nx\nc", 1, 2)
    assert h("a\nb", 1, 3) is None and h("a\nb", 0, 1) is None


PAGE = '---\ntitle: "A page"\ntype: decision\ntags: [x, "y z"]\nsources: one.pdf\ntitle: Last wins\n__proto__: bad\n---\n\n# API\ntext one\n## Errori\ntext two [[Other|o]] [l](sub/file.md#a) [e](https://x.y)\n'


def test_page_records(spark):
    files = spark.createDataFrame([("a.md", PAGE), ("b.md", "plain")], "path string, raw string")
    a, b = page_files.records(files).orderBy("path").collect()
    assert (a.title, a.type, a.tags, a.sources, a.aliases) == ("Last wins", "decision", ["x", "y z"], ["one.pdf"], [])
    assert a.body.startswith("# API") and (b.title, b.type, b.body) == ("b.md", "unknown", "plain")
    p = page_files.passages(page_files.records(files)).orderBy("path", "pos").collect()
    assert [(x.path, x.heading) for x in p] == [("a.md", "API"), ("a.md", "Errori"), ("b.md", "Introduzione")]
    assert all(a.body[x.char_start:].startswith(x.text) for x in p if x.path == "a.md")
    assert one(spark, T.wiki_links(F.col("t")), t=a.body) == ["Other", "sub/file.md"]


def test_page_scan_and_uris(spark, tmp_path):
    for name, raw in {"a b/x.md": PAGE, ".hidden/y.md": "no", "index.md": "no", "z.md": "body"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(raw)
    got = page_files.read(spark, str(tmp_path))
    assert sorted(r.raw for r in got.collect()) == sorted([PAGE, "body"])
    pages = page_files.records(spark.createDataFrame([("a b/x.md", PAGE)], "path string, raw string"))
    ps = page_files.passages(pages)
    uris = ps.select(page_files.page_uri(F.col("path"), F.col("passage_id")).alias("uri")).unionByName(pages.select(page_files.page_uri(F.col("path")).alias("uri")))
    uris = uris.unionByName(spark.createDataFrame([("page://../x",), ("file://x",), ("page://a%20b/x.md#p-0000000000000000",), ("page://gone.md",)], "uri string"))
    problems = sorted(str(r.problem) for r in page_files.resolved(uris, pages, ps).collect())
    assert problems == ["None", "None", "None", "invalid_uri", "invalid_uri", "missing_page", "stale_passage"]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_normalized_files(spark):
    sheet = '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'
    xlsx = _zip({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
    pptx = _zip({f"ppt/slides/slide{i}.xml": f'<s xmlns="a"><t>text {i}</t></s>' for i in (10, 2)})
    files = spark.createDataFrame([("a.xlsx", xlsx), ("b.pptx", pptx), ("c.txt", b"hi"), ("d.png", b"x"), ("e.xlsx", b"broken")], "path string, content binary")
    got = {r.path: r for r in page_files.normalized(files).collect()}
    assert "name | 5" in got["a.xlsx"].markdown and got["b.pptx"].markdown.split("\n") == ["## Slide 1", "- text 2", "## Slide 2", "- text 10"]
    assert got["c.txt"].markdown == "hi" and got["d.png"].problem and got["e.xlsx"].problem
    assert page_files.normalized(files.filter("path = 'd.png'"), lambda b: "seen").first().markdown == "seen"
    assert one(spark, page_files.csv_markdown(F.col("t")), t="a, b,c\n\n1,2\n") == "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 |  |"


def test_metrics_known_values(spark):
    hits = spark.createDataFrame([(1, p, i + 1) for i, p in enumerate("BAXC")], "qid long, path string, rank int")
    judged = spark.createDataFrame([(1, "A", 3), (1, "B", 2), (1, "C", 1), (2, "A", 0)], "qid long, path string, grade int")
    at2 = {r.qid: r for r in metrics.evaluation(hits, judged, 2).collect()}
    assert (at2[1].recall, at2[1].precision, at2[1].mrr) == (pytest.approx(2 / 3, abs=1e-6), 1, 1)
    assert {r.qid: r for r in metrics.evaluation(hits, judged, 4).collect()}[1].ndcg > 0.7
    assert (at2[2].recall, at2[2].precision, at2[2].mrr, at2[2].ndcg) == (1, 0, 0, 0)


def test_type_filter_keeps_statistics(spark):
    rows = [("a", "T1", "x", ["t"], ["s"], "R", "apple pie"), ("b", "T2", "y", ["t"], ["s"], "R", "apple tart apple")]
    pages = spark.createDataFrame(rows, "path string, title string, type string, tags array<string>, sources array<string>, request_id string, body string")
    q = spark.createDataFrame([(1, ["apple"])], "qid long, terms array<string>")
    every = {r.path: r.score for r in lexical.bm25(pages, q).collect()}
    assert lexical.bm25(pages, q, page_types=["x"]).collect()[0].score == every["a"]
    assert every["b"] > every["a"]


def test_twenty_pages_of_a_request_make_twenty_edges(spark):
    pages = spark.range(20).selectExpr("cast(id AS string) AS path", "cast(id AS string) AS title", "'page' AS type", "array() AS tags", "array() AS sources", "'REQ-1' AS request_id", "'' AS body")
    pages = pages.withColumns({"tags": F.array().cast("array<string>"), "sources": F.array().cast("array<string>")})
    assert graph.metadata_edges(pages).filter("kind = 'same_request'").count() == 20


def test_links_resolve_by_title_file_and_path(spark):
    """A target in .md is a path from the linking page's folder, exactly; others are titles, then file names."""
    rows = [("a.md", "A", "[[b page]] [x](dir/my-file.md) [y](dir/My_File.md) [[none]] [[My File]]"), ("b.md", "B page", ""), ("c.md", "B page", ""), ("dir/my-file.md", "F", "[u](../a.md) [v](./other.md) [w](a.md)"), ("dir/other.md", "O", ""), ("other.md", "P", "")]
    pages = spark.createDataFrame(rows, "path string, title string, body string")
    got = {(r.path, r.target): r.resolved for r in graph.resolved_links(pages).collect()}
    a = {"b page": "c.md", "dir/my-file.md": "dir/my-file.md", "dir/My_File.md": None, "none": None, "My File": "dir/my-file.md"}
    f = {"../a.md": "a.md", "./other.md": "dir/other.md", "a.md": None}
    assert got == {("a.md", k): v for k, v in a.items()} | {("dir/my-file.md", k): v for k, v in f.items()}
    names = spark.createDataFrame([("b PAGE",), ("other",)], "name string")
    assert {(r.name, r.path) for r in graph.link_matches(pages, names).collect()} == {("b PAGE", "b.md"), ("b PAGE", "c.md"), ("other", "dir/other.md"), ("other", "other.md")}


def test_set_wise_expansion_is_the_walk(spark):
    rng = np.random.RandomState(0)
    edges = spark.createDataFrame([(f"n{rng.randint(40):02d}", ["links_to", "tests", "has_tag"][rng.randint(3)], f"n{rng.randint(40):02d}") for _ in range(120)], "src string, kind string, dst string").filter("src <> dst").distinct()
    kinds = spark.createDataFrame([(f"n{i:02d}", "tag" if i % 9 == 0 else "page") for i in range(40)], "node string, kind string")
    seeds = spark.createDataFrame([(q, f"n{(q * 7 + j) % 40:02d}", 1.0 / (j + 1)) for q in range(6) for j in range(2)], "qid long, node string, score double")
    for depth, beam, seen in ((0, 8, 32), (1, 3, 5), (2, 4, 12), (3, 8, 32)):
        a = graph.expand(edges, kinds, seeds, max_nodes=5, depth=depth, beam=beam, max_visited=seen)
        b = graph.expand_exact(edges, kinds, seeds, max_nodes=5, depth=depth, beam=beam, max_visited=seen)
        key = lambda d: sorted((r.qid, r.place, r.node, round(r["value"], 9)) for r in d.collect())
        assert key(a) == key(b)


def test_request_hub_passes_siblings_on(spark):
    edges = spark.createDataFrame([(f"page:{i}", "same_request", "request:R") for i in range(3)], "src string, kind string, dst string")
    kinds = spark.createDataFrame([("request:R", "request"), *((f"page:{i}", "page") for i in range(3))], "node string, kind string")
    got = graph.expand_exact(edges, kinds, spark.createDataFrame([(1, "page:0", 1.0)], "qid long, node string, score double"), depth=1).collect()
    assert {r.node for r in got} == {"page:0", "page:1", "page:2", "request:R"}


def test_lsh(spark):
    v = np.random.RandomState(1).randn(200, 8)
    df = spark.createDataFrame([(i, [float(x) for x in r / np.linalg.norm(r)]) for i, r in enumerate(v)], "id long, vec array<float>")
    q = df.filter("id < 5")
    normals = vector.planes(8, 8, 4, "s")
    assert (normals == vector.planes(8, 8, 4, "s")).all() and np.allclose(np.linalg.norm(normals, axis=2), 1, atol=1e-6)
    assert vector.keys(q, normals, 3).groupBy("id").count().filter("count <> 24").count() == 0
    hits = vector.search(df, q, k=5, minimum=-1, tables=8, bits=4, probes=3, dim=8).collect()
    assert all(r.qid == r.id and r.score == 1 for r in hits if r["rank"] == 1)
    best = {(r.qid, r.id) for r in vector.exact(df, q, k=5).collect()}
    assert len(best & {(r.qid, r.id) for r in hits}) / len(best) > 0.8
    assert vector.top(spark.createDataFrame([(1, 1, float("nan")), (1, 2, 0.5)], "qid long, id long, score double"), 5, 0).count() == 1


def test_budget_keeps_the_first_and_stops(spark):
    hits = spark.createDataFrame([(1, 1, 90), (1, 2, 5), (1, 3, 50), (1, 4, 1), (2, 1, 500), (2, 2, 1)], "qid long, rank int, tokens long")
    assert sorted((r.qid, r["rank"]) for r in fusion.within_budget(hits, "tokens", 100).collect()) == [(1, 1), (1, 2), (2, 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#|`\n d", max_size=400), st.integers(5, 80))
def test_segments_lose_nothing(text, limit):
    parts = evidence.segment(text, limit)
    assert "".join(text[a:b] for a, b in parts) == text
    assert all(0 < b - a <= limit for a, b in parts)


def test_segment_ids_count_occurrences(spark):
    s = evidence.segments(spark.createDataFrame([("u", "# A\nx\n# A\nx\n"), ("v", None)], "source_uri string, content string"))
    rows = sorted(s.collect(), key=lambda r: r.seq)
    assert [r.occurrence for r in rows] == [0, 1] and rows[0].segment_id != rows[1].segment_id and rows[0].segment_id.startswith("seg-")
    assert evidence.contiguity(s).first().complete


def test_replay_and_collisions(spark):
    snap = spark.createDataFrame([("a", 1), ("b", 1)], "path string, size long")
    log = spark.createDataFrame([("a", 2, 1, False), ("a", 3, 2, False), ("b", 0, 3, True), ("c", 9, 4, False)], "path string, size long, seq int, deleted boolean")
    assert sorted((r.path, r["size"]) for r in evidence.merged_on_read(snap, log).collect()) == [("a", 3), ("c", 9)]
    assert evidence.collisions(spark.createDataFrame([("A.md",), ("a.md",), ("b.md",)], "path string")).first().n == 2


def test_widening_stops_where_enough(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    attempt = lambda open_, b: open_.withColumn("path", F.lit(str(b)))
    enough = lambda hits: hits.filter("qid = 1 OR level > 0")
    got = sorted((r.qid, r.level) for r in context.widened(q, attempt, enough, [1, 2, 3]).collect())
    assert got == [(1, 0), (2, 1)]
    assert context.levels({"seeds": 8, "nodes": 60, "depth": 3, "evidence": 10, "tokens": 2000}, {"seeds": 2, "nodes": 12, "depth": 1, "evidence": 4, "tokens": 700})[1] == {"seeds": 4, "nodes": 24, "depth": 2, "evidence": 6, "tokens": 1050}


def test_ordering_takes_each_wanted_category_first(spark):
    rows = [(1, "a", 1, ["tests"]), (1, "b", 2, ["requirements"]), (1, "c", 3, ["constraints", "invariants"]), (1, "d", 4, [])]
    got = context.ordered(spark.createDataFrame(rows, "qid long, path string, rank int, categories array<string>"), "implement")
    assert [r.path for r in sorted(got.collect(), key=lambda r: r.place)] == ["b", "c", "a", "d"]


SAMPLES = {
    "a/Shop.ts": ("import x from 'lib'\n// makes orders\nexport class Shop {\n  total(a: number): number {\n    return add(a)\n  }\n}\nconst run = (q) => { app.get('/orders', q); process.env.SHOP_KEY }\n", {"Shop", "total", "run"}),
    "a/Shop.java": ("package a;\nimport b.C;\npublic class Shop {\n  @GetMapping(\"/orders\")\n  public int total(int a) {\n    return add(a);\n  }\n}\n", {"Shop", "total"}),
    "a/shop.kt": ("class Shop {\n  fun total(a: Int): Int { return add(a) }\n}\n", {"Shop", "total"}),
    "a/Shop.cls": ("public class Shop {\n  public Integer total(Integer a) {\n    return [SELECT Id FROM Account].size();\n  }\n}\n", {"Shop", "total"}),
    "a/Shop.cs": ("namespace N {\n  public class Shop {\n    [HttpGet(\"/orders\")]\n    public int Total(int a) { return Add(a); }\n  }\n}\n", {"N", "Shop", "Total"}),
    "a/shop.go": ("package shop\ntype Shop struct {\n}\nfunc (s *Shop) Total(a int) int {\n  r.GET(\"/orders\", s)\n  return add(a)\n}\n", {"Shop", "Total"}),
    "a/shop.rs": ("struct Shop { a: i32 }\nimpl Shop {\n  fn total(&self) -> i32 { add(1) }\n}\n", {"Shop", "total"}),
    "a/shop.php": ("<?php\nclass Shop {\n  function total($a) { return add($a); }\n}\nRoute::get('/orders', 'x');\n", {"Shop", "total"}),
    "a/shop.cpp": ("#include <x>\nnamespace n {\nclass Shop {};\n}\nint total(int a) {\n  return add(a); // \"{\n}\n", {"n", "Shop", "total"}),
    "a/shop.py": ('"""class No: pass"""\nimport os\nclass Shop:\n    def total(self, a):\n        return add(a)\n\n    def other(self):\n        return "SELECT x FROM orders"\n', {"Shop", "total", "other"}),
    "a/shop.rb": ("require 'x'\nclass Shop\n  def total(a)\n    if a\n      add(a)\n    end\n  end\nend\n", {"Shop", "total"}),
    "a/Shop.object": ("<CustomObject><label>Shop</label></CustomObject>", {"Shop"}),
}


def test_code_fragments_of_every_language():
    for path, (text, symbols) in SAMPLES.items():
        got = [f for f in code_files.extract(path, text) if f["kind"] != "module"]
        assert {f["symbol"] for f in got} == symbols, path
        for f in got:
            if f["symbol"].lower() == "total" and not path.endswith(".object"):
                assert "add" in map(str.lower, f["calls"]) or path.endswith(".cls"), path
    shop = {f["symbol"]: f for f in code_files.extract("a/Shop.ts", SAMPLES["a/Shop.ts"][0])}
    assert shop["total"]["qualified_name"] == "Shop.total" and shop["Shop"]["doc_comment"] == "makes orders" and shop["Shop"]["imports"] == [] and shop["run"]["config_keys"] == ["SHOP_KEY"]
    assert shop["run"]["routes"] == [{"method": "GET", "path": "/orders"}] and (shop["total"]["start_line"], shop["total"]["end_line"]) == (4, 6)
    assert {f["symbol"]: f for f in code_files.extract("a/shop.py", SAMPLES["a/shop.py"][0])}["other"]["database_refs"] == ["orders"]
    assert code_files.extract("a.txt", "x") == [] and code_files.language_for("x.d.ts").name == "typescript"


#: Text that isn't code, names with packages and owners, routes with the path of their type: (file, text, qualified names, routes of one).
MASKS = [
    ("a.java", 'package com.a;\n@RequestMapping("/orders")\npublic class C {\n  /** Load one. */\n  @GetMapping("/{id}")\n  public Order load(String id) {\n    String x = """\n  class No { void f() {\n""";\n    return find(id);\n  }\n}\n', ["com.a.C", "com.a.C#load"], ("GET", "/orders/{id}")),
    ("a.rs", '/* a /* fn no() {} */ fn no2() {} */\nstruct S;\nimpl T for S {\n  fn go(&self) { let x = r##"fn n() { "# "##; run(\'{\') }\n}\nfn free() {}\n', ["S", "S::go", "free"], None),
    ("a.kt", 'package x.y\nclass C {\n  fun f(): String { return "a ${ g("}") } }" }\n  fun h() {}\n}\n', ["x.y.C", "x.y.C.f", "x.y.C.h"], None),
    ("a.go", "package shop\ntype Shop struct {\n}\nfunc (s *Shop) Total(a int) int {\n  return add(a)\n}\nfunc free() {}\n", ["Shop.Total", "shop.Shop", "shop.free"], None),
    ("a.php", '<?php\nnamespace App\\Orders;\nclass Shop {\n  function total($a) { $q = <<<SQL\nx {\nSQL;\n return add($a); }\n}\n?>\n<p>function no() {</p>\n<?php function yes() {}\n', ["App\\Orders\\Shop", "App\\Orders\\Shop::total", "App\\Orders\\yes"], None),
    ("a.cpp", '#define X(a) \\\n  int no() { }\nnamespace n {\nclass Shop {\n int total(int a) {\n  return add(R"x({ )" )x");\n}\n};\n}\n', ["n", "n::Shop", "n::Shop::total"], None),
    ("a.cs", 'namespace N.M {\n  [Route("api/orders")]\n  public class Shop {\n    [HttpGet("{id}")]\n    public int Total(int a) { var s = $"{F("}")} }}"; var v = @"c:\\"; return Add(a); }\n  }\n}\n', ["N.M", "N.M.Shop", "N.M.Shop.Total"], ("GET", "/api/orders/{id}")),
    ("a.rb", "class Shop\n  def total(a)\n    q = <<~SQL\n      def no\n    SQL\n    add(a)\n  end\n  def b\n  end\nend\n", ["Shop", "Shop#b", "Shop#total"], None),
    ("a.trigger", "trigger T on Account (before insert, after update) {\n  f();\n}\n", ["T"], ("TRIGGER", "BEFORE INSERT")),
    ("a.cls", "@RestResource(urlMapping='/accounts/*')\nglobal class A {\n  @HttpGet\n  global static Account load() {\n    return q();\n  }\n}\n", ["A", "A.load"], ("GET", "/accounts/*")),
    ("a.ts", "const a = `x ${ f(`}`) } class No {`;\nexport class Yes {\n  go(): void {\n    run()\n  }\n}\n", ["Yes", "Yes.go"], None),
]


@pytest.mark.parametrize("path,text,names,route", MASKS)
def test_code_is_told_from_text(path, text, names, route):
    got = [f for f in code_files.extract(path, text) if f["kind"] != "module"]
    assert sorted(f["qualified_name"] for f in got) == names
    assert route is None or {"method": route[0], "path": route[1]} in got[-1]["routes"]
    assert path != "a.java" or got[-1]["doc_comment"] == "Load one."


@pytest.mark.parametrize("path,text", [("a.cs", '$"' + "{a" * 50_000), ("a.kt", '"' + "${a" * 50_000), ("a.ts", "`" + "${a" * 50_000), ("a.rs", "/*" * 50_000), ("a.php", "<<<A\n" * 50_000), ("a.cpp", 'R"(' * 50_000), ("a.java", '"""' * 50_001), ("a.js", "/* " * 50_000)])
def test_open_strings_and_comments_cost_little(path, text):
    start = time.time()
    assert len(code_files.extract(path, text)) >= 1
    assert time.time() - start < 20


def test_code_search(spark, tmp_path):
    for path, (text, _) in SAMPLES.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    files = code_files.read(spark, str(tmp_path))
    f = code_files.fragments(files).cache()
    assert f.select("path").distinct().count() == len(SAMPLES)
    assert code.search(f, "total").first().symbol.lower() == "total"
    assert {r.score for r in code.symbol(f, "Shop::total").collect()} == {200, 80}
    refs = code.references(f, spark.createDataFrame([("add",)], "target string")).collect()
    assert refs and {r.how for r in refs} <= {"call", "reference"}


def test_incremental_is_a_rebuild(spark, tmp_path):
    from evidentia.sources import corpus

    pages = corpus.pages(spark, "/root/testdata/sf0.001").limit(40).cache()
    n = F.substring("path", 5, 9).cast("long")
    change = lambda d, seq, gone: d.withColumns({"seq": F.lit(seq), "deleted": F.lit(gone)})
    first = change(pages, 1, False)
    second = change(pages.filter(n % 5 == 0), 2, True).unionByName(change(pages.filter(n % 7 == 1).withColumn("body", F.lit("new body here")), 3, False))
    src = str(tmp_path / "in")
    state = incremental.Maintained(spark, str(tmp_path / "state"))
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(src)
        state.follow(spark.readStream.schema(batch.schema).parquet(src), str(tmp_path / "cp")).awaitTermination()
    want = evidence.merged_on_read(pages, second)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(state.read("pages").select(*want.columns)) == rows(want)
    fresh = lexical.postings(want)
    assert rows(state.read("postings").select(*fresh.columns)) == rows(fresh)
    assert rows(state.read("edges").select("src", "kind", "dst")) == rows(graph.metadata_edges(want))
    v = state.version()
    state.apply(first, v[1])  # a batch seen before
    assert state.version() == v


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "ev")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = incremental.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.window_start, r.event_type): r.events for r in incremental.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert {(r.window_start, r.event_type): r.events for r in spark.table("w").collect()} == batch
