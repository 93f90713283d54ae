"""WARC archives, wavelet shards, packing and counts: exact round trips and comparison with the library."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe, encoding, packing, warc, wavelet
from evidentia.llm.common import scratch

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "  a  b ", "a\n\n  b", " a", "a ", "<|endoftext|>x <|endoftext|> y<|startoftext|>z", "it's x 　 y", "a\tb \tc", " ", "\n", "x" * 3000, "日本語 テキスト", "é ́x", "ΑΣ ΣΑΣ.Σ", "a\x1cb \x1c c", "don't 'll  've", "１２３ ½ ²", "a.b,c ,d .e", "a\x01.b", "<|STARTOFTEXT|> X"]


def test_warc_round_trip_and_revisits(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other"), (4, "u\r\nx", None), (5, "v", ""), (None, "n", "same"), (6, "w", "é" * 200_000), (2, "http://a/2", "same"), (None, None, "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS body", "1 AS key", "2 AS winner")
    root = scratch(spark, "t-warc")
    got = warc.read_archives(warc.write_archives(pages, root, roll_bytes=2000), root, payloads=True, gap=10, span=5000).collect()
    assert len(got) == len(rows)
    want = {}
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        want.setdefault(i, []).append((len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if top is None or i == top else "revisit", None if top is None or i == top else top))
    for r in got:
        t = (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        assert t in want[r.page_id], (r.page_id, t)
        assert (r.payload is None) == (r.record_type == "revisit")
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "t-warc")), root).count() == 0


def test_warc_reads_only_what_is_selected(spark):
    pages = spark.range(50).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 100) AS html")
    root = scratch(spark, "t-warc")
    index = warc.write_archives(pages, root)
    got = warc.read_archives(index.filter("url LIKE '%7'"), root, payloads=True).collect()
    assert sorted(r.page_id for r in got) == [7, 17, 27, 37, 47]
    assert all(r.payload == str(r.page_id).encode() * 100 for r in got)


@pytest.mark.parametrize("path,style", [(BYTE, "byte"), (WORD, "word")])
def test_chunked_encoding_equals_the_library(path, style):
    enc, lib = encoding.ChunkEncoder(path, style, capacity=50), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab .,'\n\té1<|>") for _ in range(rng.randrange(40))) for _ in range(400)]
    for at in range(0, len(texts), 60):
        part = texts[at : at + 60]
        flat, sizes = enc.encode([*part, None])
        got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert got == [x.ids for x in lib.encode_batch(part, add_special_tokens=False)] + [[]]


def test_token_counts_equal_the_library():
    counter, lib = bpe.TokenCounter(BYTE, capacity=50), Tokenizer.from_file(BYTE)
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("abcdeth .,'\n\té1") for _ in range(rng.randrange(60))) for _ in range(300)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert counter.counts(part).tolist() == [len(x.ids) for x in lib.encode_batch(part, add_special_tokens=False)]


def test_wavelet_queries():
    ids = np.random.RandomState(0).randint(0, 300, 3000).astype(np.uint32)
    shard = wavelet.WaveletShard(wavelet.build_shard(ids, [5, None], np.array([1000, 2000])))
    assert shard.doc_ids == [5, None] and shard.lengths.tolist() == [1000, 2000]
    assert (shard.decode() == ids).all()
    for i in (0, 1, 511, 512, 2999):
        assert shard.access(i) == ids[i]
    for t in (0, 7, 299, 5000):
        where = np.flatnonzero(ids == t)
        assert shard.count(t) == len(where) and shard.count(t, 100, 900) == ((where >= 100) & (where < 900)).sum()
        assert [shard.select(t, k) for k in range(len(where))] == where.tolist()
    with pytest.raises(IndexError):
        shard.select(5000, 0)


def test_wavelet_files_of_odd_documents(spark, odd_docs, no_docs):
    root = scratch(spark, "t-wavelet")
    got = sorted(wavelet.read_shards(wavelet.write_shards(odd_docs, root, WORD, shard_tokens=8), root).collect(), key=lambda r: r.start)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    lib, at = Tokenizer.from_file(WORD), 0
    for r, want in zip(got, rows, strict=True):
        ids = np.array(lib.encode(want.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    root = scratch(spark, "t-wavelet")
    assert wavelet.read_shards(wavelet.write_shards(no_docs, root, WORD), root).count() == 0


def _check_packed(rows, cap):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs)


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, BYTE, cap=64, with_ids=True).collect()
    lib = Tokenizer.from_file(BYTE)
    total = sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.select("text").collect())
    assert sum(r.length for r in rows) == total
    assert _check_packed(rows, 64) <= -(-total // 64) + 1
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert all(r.length == 64 for r in long[1:]) and [r.start for r in long] == np.cumsum([0, *(r.length for r in long)])[:-1].tolist()
    assert b"".join(bytes(r.ids) for r in long) == np.array(lib.encode(odd_docs.filter("doc_id = 5").first().text, add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert packing.pack_documents(no_docs, BYTE).count() == 0
    filled = packing.sequences(packing.pack_documents(odd_docs, BYTE, cap=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in filled) == 4 * total


def test_plans_hold_every_piece_and_are_short():
    rng = random.Random(3)
    for cap, top in ((2048, 2048), (2048, 900), (64, 64), (10, 7)):
        counts = {}
        for _ in range(4000):
            n = min(top, max(1, int(rng.expovariate(1 / (top / 3)))))
            counts[n] = counts.get(n, 0) + 1
        runs = packing.best_plan(counts, cap)
        held = {}
        for n, content in runs:
            assert sum(s * k for s, k in content) <= cap
            for s, k in content:
                held[s] = held.get(s, 0) + n * k
        assert held == counts
        floor = -(-sum(s * n for s, n in counts.items()) // cap)
        assert sum(n for n, _ in runs) <= floor * 1.02 + 1, (cap, top)
    assert packing.best_plan({7: 3}, 10) and sum(n for n, _ in packing.best_plan({7: 3}, 10)) == 3


def test_counts_of_odd_documents(odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.select("doc_id", "text").collect())
    got = bpe.token_counts(odd_docs, BYTE, limit=20).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert bpe.token_counts(no_docs, BYTE).count() == 0
