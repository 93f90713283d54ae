"""Repeated passages across documents, found with FM-indexes.

A window is `window` consecutive words. The windows of a text are cut into segments by their minimizer
(the smallest hash of the `gram`-word runs inside a window): equal windows have equal minimizers, so a
passage meets all its repeats in the shard of its minimizer, and one pass over the corpus replaces
streaming every document against every shard. Segments whose minimizer occurs in one document only are
dropped; an index holds each sequence of words once, for the smallest document that has it (equal sequences are
told by a 128-bit digest). Each shard's segments make an FM-index (Burrows-Wheeler transform of word numbers in a
wavelet matrix of packed bit-planes), written as one compressed file and searched from what the file holds. The
segments are streamed through it by backward search, which gives the matching statistics of every place: how
many words back from there occur elsewhere too, up to `window`. Where that reaches `window`, an interval of
repeats is reported with the smallest document of its rows.

A minimizer with more words than `hot_shards` shards may hold would cost the square of that surplus in an index. The
windows of its segments are told apart by their own 128-bit digests instead, which is linear and as exact.

Words are compared by 64-bit hashes of their bytes: two windows pass for equal only if they agree in all words but
some whose hashes collide. Shards, minimizers and the order of work depend on shorter hashes, results don't.

Defined results: null or empty text has no words; a text of fewer words than a window loses nothing; null
ids take no part and keep their words; rows that repeat an id are judged by their own text and never
against each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, file_system, publish, saved, table
from .encoding import slices
from .neardup import _narrow, _runs, mix, word_hashes

_K = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of `size` words, by doubling."""
    done, width, part, power = None, 0, h, 1
    while power <= size:
        if size & power:
            # the longer run stands in front of what is done
            if done is None:
                done, width = part, power
            else:
                n = len(h) - width - power + 1
                done = part[:n] * np.uint64(pow(_K, width, 1 << 64)) + done[power : power + n] if n > 0 else part[:0]
                width += power
        n = len(part) - power
        part = part[:n] * np.uint64(pow(_K, power, 1 << 64)) + part[power:] if n > 0 else part[:0]
        power *= 2
    return done


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    part, power = x, 1
    while power * 2 <= size:
        n = len(part) - power
        part = np.minimum(part[:n], part[power:]) if n > 0 else part[:0]
        power *= 2
    rest = size - power
    n = len(x) - size + 1
    return np.minimum(part[:n], part[rest : rest + n]) if n > 0 else part[:0]


def digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def segments(h: np.ndarray, counts: np.ndarray, window: int, gram: int):
    """(text number, first word in the text, windows, minimizer, digest of the words) of the segments of a batch of texts."""
    none = np.zeros(0, np.int64)
    total = len(h) - window + 1
    if total <= 0:
        return none, none, none, none, []
    low = sliding_min(mix(rolled(h, gram)), window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)[:total]
    begin = (np.cumsum(counts) - counts)[text]
    at = np.arange(total)
    where = np.flatnonzero(at + window <= begin + counts[text])
    if not len(where):
        return none, none, none, none, []
    low, text, begin, at = low[where], text[where], begin[where], at[where]
    new = np.ones(len(where), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(where)))
    content = [digest(h[a : a + n + window - 1]) for a, n in zip(at[first].tolist(), sizes.tolist())]
    return text[first], (at - begin)[first], sizes, low[first].view(np.int64), content


class WordIndex:
    """FM-index of sequences of word numbers (from 1; 0 parts them). Suffixes are sorted by their first 64 words,
    which is as good as full order for patterns of up to 64."""

    def __init__(self, text: np.ndarray):
        if not len(text) or text[-1]:  # the word before the first one must not be a real one
            text = np.append(text, 0)
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while step < 64:
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:] + 1 if n > step else 0
            _, rank = np.unique(rank * (n + 2 if step > 1 else max(n, int(text.max(initial=0))) + 2) + behind, return_inverse=True)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        level = text[self.order - 1].astype(np.int64)
        self.n, sigma = n, int(text.max(initial=0)) + 1
        self.width = max(1, (sigma - 1).bit_length())
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.bits, self.ranks, self.zeros = [], [], []
        for bit in range(self.width - 1, -1, -1):
            on = (level >> bit & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]))]).astype(np.uint32))
            self.zeros.append(n - int(on.sum()))
            level = np.concatenate([level[np.flatnonzero(~on)], level[np.flatnonzero(on)]])
        self.base = before - self._mapped(np.arange(sigma), np.zeros(sigma, np.int64))

    def _mapped(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.width):
            w = i >> 6
            ones = self.ranks[k][w] + np.bitwise_count(self.bits[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> (self.width - 1 - k) & 1, self.zeros[k] + ones, i - ones).astype(np.int64)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of c followed by what the intervals stand for."""
        return self.base[c] + self._mapped(c, lo), self.base[c] + self._mapped(c, hi)

    def matching_statistics(self, words: np.ndarray, ends: np.ndarray, limit: int, least: np.ndarray):
        """(length, lo, hi) for each end: the longest words[end - length : end], up to `limit`, with at least `least`
        occurrences, and its interval of suffixes."""
        alive = np.arange(len(ends))
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        lo, hi = low.copy(), high.copy()
        for j in range(1, limit + 1):
            c = words[ends[alive] - j]
            known = c > 0
            alive, c, lo, hi = alive[known], c[known], lo[known], hi[known]
            lo, hi = self.step(c, lo, hi)
            keep = hi - lo >= least[alive]
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
            length[alive], low[alive], high[alive] = j, lo, hi
        return length, low, high

    def parts(self) -> tuple[dict, list[np.ndarray]]:
        return {"n": self.n, "width": self.width, "zeros": self.zeros}, [self.base, *self.bits, *self.ranks]

    @classmethod
    def of(cls, head: dict, arrays: list[np.ndarray]) -> WordIndex:
        self = cls.__new__(cls)
        self.n, self.width, self.zeros = head["n"], head["width"], head["zeros"]
        self.base, self.bits, self.ranks = arrays[0], arrays[1 : 1 + self.width], arrays[1 + self.width : 1 + 2 * self.width]
        return self


MAGIC = b"FMSHARD1"


class Shard:
    """The FM-index of a shard's segments with the words' hashes and the documents of its suffixes; a file holds all of it."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a passage shard")
        size = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12 : 12 + size])
        at, arrays, unpack = 12 + size, [], zstandard.ZstdDecompressor().decompress
        for kind, length in head["sections"]:
            arrays.append(np.frombuffer(unpack(data[at : at + length]), kind))
            at += length
        self.names, ids, codes, *rest = arrays
        self.docs = np.append(ids, np.iinfo(np.int64).max)[codes]
        self.index = WordIndex.of(head, rest)

    @staticmethod
    def built(words: list[np.ndarray], docs: np.ndarray) -> bytes:
        """File bytes for the segments `words` of the documents `docs`."""
        import zstandard

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate(words)
        names, number = np.unique(flat, return_inverse=True)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = number + 1
        index = WordIndex(text)
        ids, code = np.unique(docs, return_inverse=True)
        owner = np.minimum(np.searchsorted(ends, index.order, side="right"), len(docs))
        codes = np.append(code, len(ids)).astype(np.uint32)[owner]
        head, arrays = index.parts()
        arrays = [names, ids, codes, *arrays]
        pack = zstandard.ZstdCompressor(level=1).compress
        sections = [pack(np.ascontiguousarray(a).tobytes()) for a in arrays]
        head = json.dumps(head | {"sections": [[a.dtype.str, len(x)] for a, x in zip(arrays, sections)]}).encode()
        return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(sections)

    def first_documents(self, words: list[np.ndarray], docs: np.ndarray, window: int, own: bool) -> list[np.ndarray]:
        """For each segment and each of its windows, the smallest document with that window: the segment's own
        (docs) or one of the index. own: the segments themselves are in the index."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        q = np.concatenate(words)
        at = np.minimum(np.searchsorted(self.names, q), len(self.names) - 1)
        coded = np.where(self.names[at] == q, at + 1, 0)
        windows = sizes - window + 1
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), windows)
        starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        # equal windows are searched once; a hash groups them, their words decide
        _, first, which = np.unique(rolled(q, window)[starts], return_index=True, return_inverse=True)
        one = first[which]
        same = np.ones(len(starts), bool)
        for j in range(window):
            same &= q[starts + j] == q[starts[one] + j]
        one = np.where(same, one, np.arange(len(starts)))
        asked, which = np.unique(one, return_inverse=True)
        # a window that one asked segment alone has is a repeat only if the index has it twice
        least = np.where(own & (np.bincount(which, minlength=len(asked)) == 1), 2, 1)
        found = np.full(len(asked), np.iinfo(np.int64).max)
        for a in range(0, len(asked), 1 << 18):
            length, lo, hi = self.index.matching_statistics(coded, starts[asked[a : a + (1 << 18)]] + window, window, least[a : a + (1 << 18)])
            hit = np.flatnonzero(length == window)
            if len(hit):
                order = hit[np.argsort(lo[hit], kind="stable")]
                edges = np.column_stack([lo[order], hi[order]]).ravel()
                found[a + order] = np.minimum.reduceat(np.append(self.docs, np.iinfo(np.int64).max), edges)[::2]
        result = np.minimum(docs[owner], found[which])
        return np.split(result, np.cumsum(windows)[:-1])


def _coded(x: np.ndarray) -> bytes:
    """Run-length form: lengths and values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return np.column_stack([np.diff(np.append(first, len(x))), x[first]]).astype("<i8").tobytes()


def _decoded(data: bytes) -> np.ndarray:
    pairs = np.frombuffer(data, "<i8").reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20, shard_words: int = 400_000, hot_shards: int = 4, index_root: str | None = None) -> DataFrame:
    """doc_id, _tk (hash of the text) and spans: the segments of every document in which a window also starts in a
    document of a smaller id; each with first word and, run-length coded, the smallest document per window.

    With `index_root` (a folder of the shared store) the shards' files are kept there.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "passages")
    root = index_root or f"{ws.base}/index"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col)).alias("_tk"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                h, counts = word_hashes(batch.column(2).to_pylist(), False)
                text, start, n, low, content = segments(h, counts, window, gram)
                ids, tk = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(content, pa.binary()), pa.array(ids), pa.array(tk), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["low", "content", "doc_id", "_tk", "start", "n"])

    every = ws.saved(source.mapInArrow(cut, "low long, content binary, doc_id long, _tk int, start int, n int"), "segments")
    shared = ws.saved(every.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("low"), "minimizers")
    met = ws.saved(every.join(shared, "low", "left_semi"), "shared")
    distinct = met.groupBy("content").agg(F.first("low").alias("low"), F.min(F.struct("doc_id", "_tk", "start", "n")).alias("at")).select("content", "low", "at.*")
    distinct = ws.saved(distinct, "distinct")
    words = F.col("n") + (window - 1)
    crowded = ws.saved(distinct.groupBy("low").agg(F.sum(words).alias("words")).filter(F.col("words") > hot_shards * shard_words).select("low", F.lit(True).alias("hot")), "crowded")
    total = distinct.agg(F.sum(words)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    # shard -1: told apart window by window
    placed = distinct.join(crowded, "low", "left").withColumn("shard", F.when(F.col("hot"), -1).otherwise(F.pmod(F.xxhash64("low"), F.lit(shards))))
    per_doc = placed.groupBy("doc_id", "_tk").agg(F.collect_list(F.struct("content", "shard", "start", "n")).alias("segs"))
    texts = source.join(per_doc, ["doc_id", "_tk"]).select("doc_id", "_tk", "text", "segs")

    def spell(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                h, counts = word_hashes(batch.column(2).to_pylist(), False)
                begin = np.cumsum(counts) - counts
                segs = batch.column(3)
                sizes, flat = np.diff(segs.offsets.to_numpy()), segs.flatten()
                text = np.repeat(np.arange(batch.num_rows), sizes)
                starts = begin[text] + flat.field("start").to_numpy()
                lengths = flat.field("n").to_numpy() + (window - 1)
                spelled = [h[s : s + n].tobytes() for s, n in zip(starts, lengths)]
                yield pa.RecordBatch.from_arrays([flat.field("shard"), flat.field("content"), pa.array(batch.column(0).to_numpy()[text]), pa.array(spelled, pa.binary())], names=["shard", "content", "doc_id", "words"])

    spelled = texts.mapInArrow(spell, "shard long, content binary, doc_id long, words binary")
    none_crowded = crowded.isEmpty()
    if not none_crowded:
        spelled = ws.saved(spelled, "spelled")

    def look(batches):
        import pyarrow as pa

        fs, path = file_system(root)
        for run in _runs(_narrow(batches), 1):
            content = run.column(1).to_pylist()
            once = list(dict(zip(reversed(content), range(len(content) - 1, -1, -1))).values())
            words = [np.frombuffer(run.column(3)[k].as_py(), np.uint64) for k in once]
            ids = run.column(2).to_numpy()[once]
            # a repeated task writes files of its own; those of one shard are equal
            name = f"{run.column(0)[0].as_py()}-{uuid.uuid4().hex}.fm"
            publish(root, name, Shard.built(words, ids))
            with fs.open_input_file(f"{path}/{name}") as f:
                shard = Shard(f.read())
            found = shard.first_documents(words, ids, window, True)
            yield pa.RecordBatch.from_arrays([pa.array([content[k] for k in once], pa.binary()), pa.array([int(f.min()) for f in found], pa.int64()), pa.array([_coded(f) for f in found], pa.binary())], names=["content", "low_doc", "firsts"])

    firsts = "content binary, low_doc long, firsts binary"
    result = spelled.filter("shard >= 0").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(look, firsts)
    if not none_crowded:

        def windows(batches):
            import pyarrow as pa

            for batch in _narrow(batches):
                content, ids, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
                for k, data in enumerate(batch.column(3)):
                    words = np.frombuffer(data.as_py(), np.uint64)
                    out += [(digest(words[i : i + window]), content[k], i, ids[k]) for i in range(len(words) - window + 1)]
                cols = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.binary(), pa.int32(), pa.int64()])], names=["w", "content", "i", "doc_id"])

        def code(batches):
            import pyarrow as pa

            for batch in batches:
                rows = [np.array([x["doc"] for x in sorted(r, key=lambda x: x["i"])], np.int64) for r in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(r.min()) for r in rows], pa.int64()), pa.array([_coded(r) for r in rows], pa.binary())], names=["content", "low_doc", "firsts"])

        each = ws.saved(spelled.filter("shard < 0").mapInArrow(windows, "w binary, content binary, i int, doc_id long"), "windows")
        smallest = ws.saved(each.groupBy("w").agg(F.min("doc_id").alias("doc")), "window-documents")
        rows = each.select("w", "content", "i").join(smallest, "w").groupBy("content").agg(F.collect_list(F.struct("i", "doc")).alias("r"))
        result = result.unionByName(rows.mapInArrow(code, firsts))
    result = ws.saved(result, "firsts")
    spans = met.select("content", "doc_id", "_tk", "start").join(result, "content").filter("low_doc < doc_id")
    return ws.result(spans.groupBy("doc_id", "_tk").agg(F.collect_list(F.struct("start", "firsts")).alias("spans")), "passage-spans")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the kept words joined by blanks) for every row."""
    spans = repeated_passages(docs, id_col=id_col, text_col=text_col, window=window, **settings)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col)).alias("_tk"), F.col(text_col).alias("text")).join(spans, ["doc_id", "_tk"], "left").select("doc_id", "text", "spans")

    def drop(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = (text or "").encode().split()
                    n = len(words)
                    if found:
                        edge = np.zeros(n + 1, np.int64)
                        for s in found:
                            first = _decoded(s["firsts"])
                            hit = s["start"] + np.flatnonzero(first < doc)
                            np.add.at(edge, hit, 1)
                            np.subtract.at(edge, hit + window, 1)
                        gone = np.cumsum(edge)[:n] > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept = b" ".join(words)
                    out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                some = 5 if with_text else 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds))[:some]], names=names[:some])

    return saved(rows.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")), "passages-removed")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that start in a document of a smaller id too."""
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM v) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, i + d AS pos FROM h, (SELECT unnest(range(0, 50)) AS d)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM p ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c USING (doc_id)
"""
