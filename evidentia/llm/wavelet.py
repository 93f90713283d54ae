"""Token ids in wavelet-matrix shard files.

One file holds a run of documents: ids, lengths and, from the highest bit down, one
bit-plane per bit of an id with a rank directory. Each section is compressed by itself.
`WaveletShard` answers access, rank (counting), select (occurrence lookup) from the file alone.

Defined results: null text is the empty text (one end id); null ids sort first and come back
null; repeated ids keep all rows, ordered by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_system, publish, saved, scratch, shuffle_width, table
from .encoding import encoder, slices

MAGIC = b"WVLTSHD1"
#: Bits per entry of a rank directory.
BLOCK = 512


def build_shard(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """File bytes of one shard; `ids` are all documents' ids one after the other."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    n, width = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    level = ids.astype(np.uint16 if width <= 16 else np.uint32)
    sections = [pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()), pack(np.array([d is None for d in doc_ids], "u1").tobytes()), pack(np.asarray(lengths, "<u4").tobytes())]
    zeros = []
    for bit in range(width - 1, -1, -1):
        on = ((level >> bit) & 1).astype(bool)
        bits = np.packbits(on, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        sections += [pack(bits.tobytes()), pack(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())]
        zeros.append(int(n - on.sum()))
        level = np.concatenate([level[np.flatnonzero(~on)], level[np.flatnonzero(on)]])
    head = json.dumps({"n": n, "width": width, "docs": len(doc_ids), "zeros": zeros, "sections": [len(s) for s in sections]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(sections)


class WaveletShard:
    """Queries on one shard file."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[8:12], "little")
        head = json.loads(data[12 : 12 + size])
        self.n, self.width, self.zeros = head["n"], head["width"], head["zeros"]
        at, parts, unpack = 12 + size, [], zstandard.ZstdDecompressor().decompress
        for s in head["sections"]:
            parts.append(unpack(data[at : at + s]))
            at += s
        absent = np.frombuffer(parts[1], "u1")
        self.doc_ids = [None if a else d for d, a in zip(np.frombuffer(parts[0], "<i8").tolist(), absent)]
        self.lengths = np.frombuffer(parts[2], "<u4").astype(np.int64)
        self._bits = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
        self._ranks = [np.frombuffer(p, "<u4").astype(np.int64) for p in parts[4::2]]

    def _plane(self, level: int) -> np.ndarray:
        return np.unpackbits(self._bits[level], bitorder="little", count=self.n).astype(bool)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bits = i // BLOCK, self._bits[level]
        part = bits[block * BLOCK // 8 : (i + 7) // 8]
        return int(self._ranks[level][block]) + int(np.unpackbits(part, bitorder="little")[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(self.width):
            bit, ones = (self._bits[k][i >> 3] >> (i & 7)) & 1, self._ones(k, i)
            value, i = value << 1 | int(bit), self.zeros[k] + ones if bit else i - ones
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.width):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.width - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of `token` in positions lo..hi-1."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ranks = self._ranks[level] if bit else np.minimum(np.arange(len(self._ranks[level])) * BLOCK, self.n) - self._ranks[level]
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self._bits[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of `token`."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._span(token, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            on, out = self._plane(k), np.empty(self.n, kind)
            out[np.flatnonzero(~on)] = level[: self.zeros[k]]
            out[np.flatnonzero(on)] = level[self.zeros[k] :] | kind(1 << (self.width - 1 - k))
            level = out
        return level


def write_shards(docs: DataFrame, root: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_tokens: int = 1 << 20, style: str = "word", pool_chunks: int = 900_000) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the catalogue (one row per shard, with its first token's number).

    Documents are range-partitioned by id; a shard closes at the first document end beyond `shard_tokens`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc, ids, names, lengths, held = encoder(tokenizer_path, style, pool_chunks), [], [], [], 0
        made = []

        def close():
            nonlocal ids, names, lengths, held, seq
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wv"
            publish(root, name, build_shard(np.concatenate(ids), names, np.array(lengths)))
            made.append((part, seq, name, len(names), held))
            ids, names, lengths, held, seq = [], [], [], 0, seq + 1

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = enc.encode(batch.column(1).to_pylist())
                ends = np.cumsum(counts)
                for d, a, b in zip(batch.column(0).to_pylist(), ends - counts, ends):
                    ids += [flat[a:b], np.array([end_id], np.uint32)]
                    names.append(d)
                    lengths.append(int(b - a) + 1)
                    held += int(b - a) + 1
                    if held >= shard_tokens:
                        close()
        if names:
            close()
        if made:
            cols = list(zip(*made))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=["part", "seq", "file", "docs", "tokens"])

    shards = saved(rows.mapInArrow(write, "part long, seq long, file string, docs long, tokens long"), "token-shards")
    # first the tasks' totals, one row for each partition of the range; then a running sum inside each
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    firsts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return shards.join(firsts, "part").withColumn("first_token", F.col("first") + F.coalesce(inside, F.lit(0))).drop("first")


def read_shards(catalogue: DataFrame, root: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = catalogue.select("file", "first_token").repartition(shuffle_width(catalogue.sparkSession))

    def read(batches):
        import pyarrow as pa

        fs, path = file_system(root)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{file}") as f:
                    shard = WaveletShard(f.read())
                ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return saved(spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-documents")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with word_bpe_49k, end id 1, through wavelet shards and back."""
    import public_tokenizers

    root = scratch(spark, "wavelet")
    catalogue = write_shards(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(catalogue, root)
