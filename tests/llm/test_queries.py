"""The operators' queries beside their SQL; without SQL, beside brute force in the other files."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.compare import duck, rows
from tokenizers import Tokenizer

from evidentia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).sql(queries.ORACLES[name]).df())


def test_token_queries(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for name, vocabulary, end in (("op3_wavelet", "word_bpe_49k.json", [1]), ("op4_packing", "byte_bpe_50k.json", [0]), ("op6_bpe_counts", "byte_bpe_50k.json", [])):
        lib = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        ids = {d.doc_id: np.array(x.ids + end, "<u4") for d, x in zip(docs, lib.encode_batch([d.text or "" for d in docs], add_special_tokens=False))}
        got = queries.QUERIES[name](spark, sf).collect()
        if name == "op3_wavelet":
            at = 0
            for r in sorted(got, key=lambda r: r.doc_id):
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
                at += r.n_tokens
        elif name == "op4_packing":
            for r in got:
                assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            by_doc, by_sequence = {}, {}
            for r in got:
                by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
                by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for doc, cut in by_doc.items():
                n, cut = len(ids[doc]), sorted(cut)
                first = n % 2048 or 2048
                assert cut == [(k, max(0, first + 2048 * (k - 1)), first if k == 0 else 2048) for k in range(-(-n // 2048))]
            for held in by_sequence.values():
                at = 0
                for offset, length in sorted(held):
                    assert offset == at
                    at += length
                assert at <= 2048
            assert len(by_doc) == len(ids) and len(by_sequence) <= -(-sum(map(len, ids.values())) // 2048) + 1
        else:
            assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for i, x in ids.items()}
            assert all(r.over_limit == (r.n_tokens > 512) for r in got)
