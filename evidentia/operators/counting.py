"""Arrow stages of the lexical index: the terms of a page counted where it is read, and a task's best pages of every query.

They take Python because a text's tokens are counted many times faster there, and because the best pages are held from batch to batch.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vocab

_TOKEN = re.compile(r"/?[^\W_][\w./:#-]*")  # as T.TOKEN: letters and digits (\p{L}, \p{N}) are what \w has besides the underscore
_DELIMITERS = re.compile(T.DELIMITERS)
PAGES = 1000  # rows of a batch that are worked on at once
CELLS = 2_000_000  # pairs of query and page that are held at once


def bag(text: str) -> dict[str, int]:
    """Tokens and parts of a folded text, as `T.tokens` gives them, with their numbers."""
    out = Counter(_TOKEN.findall(text))
    for t, n in [(t, n) for t, n in out.items() if not t.isalnum()]:
        for part in _DELIMITERS.split(t):
            if len(part) >= 2 and part != t:
                out[part] += n
    return out


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values, kind))


def counted(rows: DataFrame) -> DataFrame:
    """rows with len (distinct body tokens, at least 1), terms, body_tf, title_tf, meta_tf in place of the texts _body, _names, _meta."""
    held = [f for f in rows.schema.fields if f.name not in ("_body", "_names", "_meta")]
    words, counts = ArrayType(StringType()), ArrayType(IntegerType())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                lens, sizes, terms, tf = [], [], [], ([], [], [])
                for texts in zip(*(part.column(c).to_pylist() for c in ("_body", "_names", "_meta"))):
                    body, names, meta = map(bag, texts)
                    lens.append(max(len(body), 1))
                    few = list(names | meta)
                    first = [body.pop(t, 0) for t in few]
                    sizes.append(len(few) + len(body))
                    terms += few
                    terms += body
                    for out, numbers, rest in zip(tf, (first, [names.get(t, 0) for t in few], [meta.get(t, 0) for t in few]), (body.values(), [0] * len(body), [0] * len(body))):
                        out += numbers
                        out += rest
                columns = [part.column(f.name) for f in held] + [pa.array(lens, pa.int64()), _lists(terms, sizes, pa.string()), *(_lists(x, sizes, pa.int32()) for x in tf)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in held), "len", "terms", "body_tf", "title_tf", "meta_tf"])

    more = [StructField("len", LongType()), StructField("terms", words), *(StructField(c, counts) for c in ("body_tf", "title_tf", "meta_tf"))]
    return rows.mapInArrow(run, StructType([*held, *more]))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, first + size) one after the other: the range's number and the values."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, first[of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]


class Asked:
    """Queries as arrays: their distinct words, and the queries of each word."""

    def __init__(self, terms: list[list[str]]):
        pairs = [(t, q) for q, ts in enumerate(terms) for t in ts if t is not None]
        self.words = sorted({t for t, _ in pairs})
        code = {t: i for i, t in enumerate(self.words)}
        pairs.sort(key=lambda p: (code[p[0]], p[1]))
        self.queries = np.array([q for _, q in pairs], np.int64)
        self.sizes = np.bincount([code[t] for t, _ in pairs], minlength=len(self.words)).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.asked = np.array([len(ts) for ts in terms], np.int64)

    def found(self, column: pa.Array, words: pa.Array) -> np.ndarray:
        """The number of each value among the words, -1 for none."""
        return pc.fill_null(pc.index_in(column, value_set=words), -1).to_numpy(zero_copy_only=False)

    def parts(self, batches):
        """Batches in parts of so many pages that their pairs with all queries stay within CELLS."""
        size = max(1, min(PAGES, CELLS // max(1, len(self.asked))))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield batch.slice(at, size)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def scored(rows: DataFrame, asked: Asked, df: list[int], n: int, avg_len: float, k1: float, b: float, k: int | None) -> DataFrame:
    """q, path, score, matched of page rows: of each task and query the best k, or all."""
    idf = np.log(1 + (n - np.array(df, float) + 0.5) / (np.array(df, float) + 0.5))
    most = asked.asked

    def run(batches):
        words, Q = pa.array(asked.words, pa.string()), len(most)
        floor, held, waiting = np.full(Q, -np.inf), [], 0

        def best(parts):
            """The best k of each query among candidates (arrays q, score, matched, path); raises the floors."""
            q, score, matched, path = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((path, -score, q))
            q, score, matched, path = q[order], score[order], matched[order], path[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            floor[q[last]] = np.maximum(floor[q[last]], score[last])
            keep = place < k
            return [(q[keep], score[keep], matched[keep], path[keep])]

        def out(q, score, matched, path):
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(path.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(matched, pa.int64())], ["q", "path", "score", "matched"])

        for part in asked.parts(batches):
            R = part.num_rows
            facts, copies = part.column("facts").flatten(), _sizes(part.column("facts"))
            size, length, code = _sizes(part.column("terms")), pc.struct_field(facts, "len").to_numpy(zero_copy_only=False), asked.found(part.column("terms").flatten(), words)
            at = np.flatnonzero(code >= 0)
            body, title, meta = (part.column(c).flatten().to_numpy(zero_copy_only=False)[at] for c in ("body_tf", "title_tf", "meta_tf"))
            row, code, tf = np.repeat(np.arange(R), size)[at], code[at], body + vocab.META_WEIGHT * meta + vocab.TITLE_WEIGHT * title
            # a posting counts with each page of its path
            of, fact = _ranges((np.cumsum(copies) - copies)[row], copies[row])
            row, code, tf = row[of], code[of], tf[of]
            same = (asked.found(pc.struct_field(facts, "_title"), words)[fact] == code) | (asked.found(pc.struct_field(facts, "_request"), words)[fact] == code)
            weight = idf[code] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[fact] / avg_len))) + np.where(same, vocab.EXACT_BOOST, 0.0)
            of, pair = _ranges(asked.first[code], asked.sizes[code])
            cell = row[of] * Q + asked.queries[pair]
            matched = np.bincount(cell, minlength=R * Q).reshape(R, Q)
            score = np.round(np.bincount(cell, weight[of], R * Q).reshape(R, Q) * (1 + matched / np.maximum(most, 1)), 6)
            there = matched > 0
            if k is not None:
                if R >= k:
                    np.maximum(floor, np.partition(np.where(there, score, -np.inf), R - k, axis=0)[R - k], out=floor)
                there &= score >= floor
            r, q = np.nonzero(there)
            if not len(r):
                continue
            used, back = np.unique(r, return_inverse=True)
            found = q, score[r, q], matched[r, q], np.array(part.column("path").take(pa.array(used)).to_pylist(), str)[back]
            if k is None:
                yield out(*found)
                continue
            held.append(found)
            waiting += len(r)
            if waiting > max(100_000, 4 * Q * k):
                held, waiting = best(held), 0
        if held:
            yield out(*best(held)[0])

    return rows.select("path", "facts", "terms", "body_tf", "title_tf", "meta_tf").mapInArrow(run, "q int, path string, score double, matched long")


def shared(rows: DataFrame, asked: Asked, share: float) -> DataFrame:
    """q, path, hit, asked of page rows whose bodies hold at least a share of a query's terms, one at least."""
    most = asked.asked

    def run(batches):
        words, Q = pa.array(asked.words, pa.string()), len(most)
        for part in asked.parts(batches):
            R, size, code = part.num_rows, _sizes(part.column("terms")), asked.found(part.column("terms").flatten(), words)
            at = np.flatnonzero((code >= 0) & (part.column("body_tf").flatten().to_numpy(zero_copy_only=False) > 0))
            row, code = np.repeat(np.arange(R), size)[at], code[at]
            of, pair = _ranges(asked.first[code], asked.sizes[code])
            hit = np.bincount(row[of] * Q + asked.queries[pair], minlength=R * Q).reshape(R, Q)
            r, q = np.nonzero((hit > 0) & (hit >= most * share))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), part.column("path").take(pa.array(r)), pa.array(hit[r, q], pa.int64()), pa.array(most[q], pa.int64())], ["q", "path", "hit", "asked"])

    return rows.select("path", "terms", "body_tf").mapInArrow(run, "q int, path string, hit long, asked long")
