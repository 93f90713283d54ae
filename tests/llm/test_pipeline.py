"""Every stage of the pipeline, on its own input, against what its operator must do."""

import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from evidentia.llm import quality
from evidentia.llm.common import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(saved(stage(spark, inputs[-1], sf), f"t-{name}"))
    for out in inputs[1:5]:
        assert out.columns == docs.columns
    start, clean, single, hidden, mix, packed = inputs
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    assert {r.doc_id for r in clean.collect()} == want
    from .test_text import _components

    texts = {r.doc_id: r.text for r in clean.collect()}
    comp, _ = _components(texts, 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, c in comp.items() if i == c}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (single, hidden))
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert len(t) == len(after[i])
        for found in re.findall(r"[\w.]+@[\w.]+\.com|\b\d{16}\b|\b[0-9a-f]{40}\b", t):
            assert found not in after[i]
    taken = [r.doc_id for r in mix.collect()]
    assert set(taken) <= set(after) and max(map(taken.count, taken)) <= 3
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(x.ids) + 1 for x in lib.encode_batch([r.text for r in mix.collect()], add_special_tokens=False))
    rows = packed.collect()
    assert sum(r.length for r in rows) == total
    from .test_files import _check_packed

    assert _check_packed(rows, 2048) <= total // 2048 + 2


def test_odd_documents_go_through(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        d = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            d = saved(stage(spark, d, sf), "t-odd")
        assert (d.count() > 0) == (docs is odd_docs)
