"""Exact token counts by heap-and-linked-list byte-pair merging.

The count of a pre-token is its initial symbols minus its merges; no identifier is made.
Pre-tokens repeat, so their counts are kept in a bounded table per Python worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; null
ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .encoding import chunked, slices, whole

#: The byte-level pre-tokenizer's fixed pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


def merges_of(symbols: list, ranks: dict) -> int:
    """Merges that byte-pair encoding makes: the lowest rank first, of equal ranks the leftmost."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get((symbols[i], symbols[i + 1]))
        if r is not None:
            heap.append((r[0], i, symbols[i], symbols[i + 1], r[1]))
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, left, right, joined = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], alive[j] = joined, False
        merged += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = ranks.get((joined, symbols[k]))
            if r is not None:
                heapq.heappush(heap, (r[0], i, joined, symbols[k], r[1]))
        h = before[i]
        if h >= 0:
            r = ranks.get((symbols[h], joined))
            if r is not None:
                heapq.heappush(heap, (r[0], h, symbols[h], joined, r[1]))
    return merged


class TokenCounter:
    """Counts for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, capacity: int = 600_000):
        import regex

        with open(path) as f:
            spec = json.load(f)
        vocab, self.ranks = spec["model"]["vocab"], {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.find = regex.compile(PATTERN).findall
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.capacity, self.words, self.chunks = capacity, {}, {}

    def word(self, token: str) -> int:
        known = self.words.get(token)
        if known is None:
            symbols = [self.bytes[b] for b in token.encode()]
            n = len(symbols)
            known = n - merges_of(symbols, self.ranks) if n > 1 else n
            if len(token) < 64:
                self.words[token] = known
        return known

    def plain(self, text: str) -> int:
        return sum(map(self.word, self.find(text)))

    def _count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1

    def _chunk(self, chunk: str) -> int:
        n = self.chunks.get(chunk)
        if n is None:
            n = self._count(chunk)
            if len(chunk) < 64:
                self.chunks[chunk] = n
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text; a special string inside one is one token, as by the library's default."""
        apart = {i: self._count(texts[i]) for i in whole(texts, "byte")}
        names, codes, places = chunked(["" if i in apart else t for i, t in enumerate(texts)], "byte")
        each = np.fromiter(map(self._chunk, names), np.int64, len(names))
        ends = np.concatenate([[0], np.cumsum(each[codes])])[np.concatenate([[0], np.cumsum(places)])]
        n = np.diff(ends)
        for i, k in apart.items():
            n[i] = k
        for known in (self.words, self.chunks):
            if len(known) > self.capacity:
                # the oldest entries are the frequent ones
                for c in list(known)[self.capacity // 2 :]:
                    del known[c]
        return n


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        import pyarrow as pa

        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path)
        counter = _COUNTERS[tokenizer_path]
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = counter.counts(texts)
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token counts with byte_bpe_50k; limit 512."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
