"""What grows with the tables: bytes shuffled, and steps that a plan must not hold."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import vocab
from evidentia.operators import counting, graph, lexical, metrics, semantic
from evidentia.operators.kept import root
from evidentia.plans import registry
from evidentia.sources import code


def shuffled(spark, run) -> int:
    """Bytes that the tasks of `run` write for a shuffle."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = total()
    run()
    return total() - before


@pytest.fixture
def joins_shuffle(spark):
    """Only what is told to be held by every task is, as with tables that are too large for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _pages(spark, n):
    """Pages of 40 words each, of which queries hold ten."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), (F.col("id") * (i + 1) % 97).cast("string"))), " ")
    p = spark.range(n).select(F.concat(F.lit("p/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.lit("A page").alias("title"), F.lit("note").alias("type"), F.lit("R-1").alias("request_id"), words.alias("body"))
    return p.withColumns({"tags": F.array(F.lit("t")), "sources": F.array(F.lit("s"))})


def _queries(spark, n):
    return spark.range(n).select(F.col("id").alias("qid"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("id") + i) % 97).cast("string"))).alias("terms"))


def test_postings_and_scores_are_not_shuffled(spark, joins_shuffle):
    p, q = _pages(spark, 2000), _queries(spark, 50)
    assert shuffled(spark, lambda: lexical.postings(p).write.format("noop").mode("overwrite").save()) < 100_000
    index = lexical.LexicalIndex.create(p, f"{root(spark)}/lexical")
    assert shuffled(spark, lambda: lexical.bm25(index, q).write.format("noop").mode("overwrite").save()) < 100_000


def test_texts_of_hits_are_not_shuffled(spark, sf, joins_shuffle):
    registry.QUERIES["bm25_balanced"](spark, sf)  # builds the index
    for name, most in (("query_coverage", 40_000), ("best_passage", 250_000), ("token_budget_prefix", 40_000), ("merge_hits", 60_000), ("rrf_fusion", 400_000)):
        assert shuffled(spark, lambda: registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()) < most, name


def test_bags_are_the_tokens(spark):
    texts = ["", "Plain words, twice words.", "a-b //x/y _z_ foo_bar.baz... REQ-12 #7 1.5", "Ünïcode ÅÄÖ日本語 x² Ⅷ ½ naïve-café", "/services/data/v1 a/ /a - _ ."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), T.tokens(F.col("t")).alias("tokens")).collect()
    for r in got:
        assert counting.bag(r.low) == Counter(r.tokens), r.low


def _naive(pages, terms, k1, b):
    """path, rounded score of BM25 by its formula."""
    tokens = lambda t: list(counting.bag(t.lower()).elements())
    n = len(pages)
    avg = max(sum(max(len(set(tokens(body))), 1) for _, _, body in pages) / n, 1.0)
    held: dict = {}
    for path, title, body in pages:
        h = held.setdefault(path, Counter())
        for t in tokens(body):
            h[t] += 1
        for t in tokens(title):
            h[t] += vocab.TITLE_WEIGHT
        for t in tokens(f"note t s R-1 {path}"):
            h[t] += vocab.META_WEIGHT
    out: dict = {}
    for path, title, body in pages:
        length = max(len(set(tokens(body))), 1)
        for t in terms:
            if held[path][t]:
                df = sum(1 for h in held.values() if h[t])
                s = math.log(1 + (n - df + 0.5) / (df + 0.5)) * held[path][t] * (k1 + 1) / (held[path][t] + k1 * (1 - b + b * length / avg)) + (vocab.EXACT_BOOST if t in (title.lower(), "r-1") else 0)
                x = out.setdefault(path, [0.0, 0])
                x[0] += s
                x[1] += 1
    return {p: (round(s * (1 + m / len(terms)), 6), m) for p, (s, m) in out.items()}


def test_scores_are_those_of_the_formula(spark):
    """Also where two pages have one path, and over parts of few pages with floors and ties."""
    rows = [(f"p{i:03}", "apple" if i % 9 == 0 else "T", " ".join(["apple"] * (i % 4) + ["pie"] * (i % 3) + [f"x{j}" for j in range(i % 7)])) for i in range(60)]
    rows.append(("p003", "Twice", "apple tart apple"))
    p = spark.createDataFrame(rows, "path string, title string, body string").withColumns({"type": F.lit("note"), "request_id": F.lit("R-1"), "tags": F.array(F.lit("t")), "sources": F.array(F.lit("s"))})
    q = spark.createDataFrame([(1, ["apple", "pie"]), (2, ["tart"]), (3, ["nowhere"])], "qid long, terms array<string>")
    index = lexical.LexicalIndex.create(p.repartition(3), f"{root(spark)}/lexical")
    k1, b = vocab.PROFILES["balanced"]
    for source in (index, p):
        every = {(r.qid, r.path): (r.score, r.matched) for r in lexical.bm25(source, q, k=None).collect()}
        want = {(qid, path): v for qid, terms in ((1, ["apple", "pie"]), (2, ["tart"])) for path, v in _naive(rows, terms, k1, b).items()}
        assert every.keys() == want.keys() and all(every[x][1] == want[x][1] and every[x][0] == pytest.approx(want[x][0], abs=2e-6) for x in want)
        first = [(r.path, r.rank) for r in lexical.bm25(source, q, k=5).filter("qid = 1").orderBy("rank").collect()]
        assert first == [(path, i + 1) for i, (_, path) in enumerate(sorted((-s, path) for (qid, path), (s, _) in every.items() if qid == 1)[:5])]
    assert {(r.path, r.term): r.body_tf for r in index.postings().collect()}["p003", "apple"] == 5
    size, counting.CELLS = counting.CELLS, 12
    try:
        asked, _ = lexical._asked(q)
        assert [b.num_rows for b in asked.parts(iter([p.select("path").toArrow().to_batches()[0]]))][:2] == [4, 4]
    finally:
        counting.CELLS = size


def test_the_ideal_order_is_counted_not_sorted(spark):
    hits = spark.createDataFrame([(1, f"p{i}", i + 1) for i in range(4)], "qid long, path string, rank int")
    judged = spark.createDataFrame([(1, f"p{i}", 1 + i % 3) for i in range(2, 30)], "qid long, path string, grade int")
    out = metrics.evaluation(hits, judged, 4)
    gain = lambda g: 2**g - 1
    dcg = sum(gain(1 + i % 3) / math.log2(i + 2) for i in (2, 3))
    best = sum(gain(g) / math.log2(i + 2) for i, g in enumerate(sorted((1 + i % 3 for i in range(2, 30)), reverse=True)[:4]))
    r = out.first()
    assert (r.ndcg, r.precision, r.recall, r.mrr) == (pytest.approx(dcg / best, abs=1e-6), 0.5, pytest.approx(2 / 28, abs=1e-6), pytest.approx(1 / 3, abs=1e-6))
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_hub_passes_on_its_best_neighbours_only(spark):
    """Every query reaches the hub, whose neighbours grow with the graph: what the last hop gives the beam mustn't be all of them."""
    n = 3000
    edges = spark.range(n).select(F.format_string("c:%05d", "id").alias("src"), F.lit("derived_from").alias("kind"), F.lit("n:0").alias("dst"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    kinds = ends.select("node", F.split("node", ":")[0].alias("kind"))
    seeds = spark.range(0, n, 10).select(F.col("id").alias("qid"), F.format_string("c:%05d", "id").alias("node"), F.lit(1.0).alias("score"))
    got = []
    size = shuffled(spark, lambda: got.extend(graph.expand(edges, kinds, seeds, max_nodes=12, depth=2, beam=8, max_visited=32).collect()))
    assert size < 2_000_000
    own = [r.node for r in sorted((r for r in got if r.qid == 10), key=lambda r: r.place)]
    assert own == ["c:00010", "n:0", *(f"c:{i:05}" for i in range(8))] and len(got) == 10 * n // 10


def test_small_code_files_are_dealt_to_all_tasks(spark):
    files = spark.range(40).select(F.concat(F.lit("f"), F.col("id"), F.lit(".py")).alias("path"), F.lit("def f():\n    pass\n").alias("content")).coalesce(1)
    out = code.fragments(files)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.filter("kind = 'function'").count() == 40


def test_fingerprints_are_made_once(spark, monkeypatch):
    made, own = [], semantic.fingerprints
    tried = spark.sparkContext.accumulator(0)

    def noted(passages):
        made.append(1)
        return own(passages.mapInPandas(lambda parts: (tried.add(len(p)) or p for p in parts), passages.schema))

    monkeypatch.setattr(semantic, "fingerprints", noted)
    index = semantic.SemanticIndex(spark, f"{root(spark)}/semantic", lambda t: [[1.0, 0.0] for _ in t], 2, "one")
    rows = spark.createDataFrame([(f"p{i}", 0, f"i{i}", "", "text") for i in range(20)], "path string, pos int, passage_id string, heading string, text string")
    assert index.synchronize(rows) == {"reused": 0, "embedded": 20, "removed": 0, "passages": 20}
    assert made == [1] and tried.value == 20
