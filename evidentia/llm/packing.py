"""Packing documents into fixed-length training sequences by a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so the instance is its histogram: at most
`cap` rows reach the driver however many documents there are. On the histogram: large lengths are
put into groups of equal cardinality and rounded up to their group's largest, configurations for
these few sizes are optimised by column generation, the actual lengths take the places of the
rounded ones, and small lengths fill the gaps by best fit (largest first). The plan is a list of
runs of equally filled sequences; each document finds its place from its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table
from .encoding import encoder, slices

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _configurations(sizes: list[int], demand: list[int], cap: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Column generation for the covering problem of few sizes: (copies of each size, sequences) of the best basis."""
    g = len(sizes)
    basis = np.diag([cap // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(rounds):
        amount = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(g))
        best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
        for w in range(1, cap + 1):
            best[w] = best[w - 1]
            for i, s in enumerate(sizes):
                if s <= w and best[w - s] + price[i] > best[w] + 1e-12:
                    best[w], pick[w] = best[w - s] + price[i], i
        if best[cap] <= 1 + 1e-7:
            break
        column, w = np.zeros(g), cap
        while w > 0:
            if pick[w] < 0:
                w -= 1
            else:
                column[pick[w]] += 1
                w -= sizes[pick[w]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.maximum(step, 1e-9), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int), a) for i, a in enumerate(amount) if a > 1e-9]


class _Bins:
    """Runs of equally filled sequences, by the room left."""

    def __init__(self, cap: int):
        self.cap, self.rooms, self.runs = cap, [], {}

    def add(self, room: int, count: int, content: tuple) -> None:
        if count <= 0:
            return
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((count, content))

    def fit(self, size: int, count: int) -> None:
        """Best fit of `count` pieces of one size: always the fullest sequence that still has room."""
        while count > 0:
            i = bisect.bisect_left(self.rooms, size)
            if i == len(self.rooms):
                each = self.cap // size
                self.add(self.cap - each * size, count // each, ((size, each),))
                if count % each:
                    self.add(self.cap - count % each * size, 1, ((size, count % each),))
                return
            room = self.rooms[i]
            bins, content = self.runs[room].pop()
            each = room // size
            used = min(bins, count // each)
            self.add(room - each * size, used, content + ((size, each),))
            count -= used * each
            if used < bins:
                some = min(count, each)
                if some:
                    self.add(room - some * size, 1, content + ((size, some),))
                self.add(room, bins - used - bool(some), content)
                count -= some
            if not self.runs.get(room):
                self.runs.pop(room, None)
                self.rooms.remove(room)


def plan(counts: dict[int, int], cap: int, groups: int, small_share: float) -> list[tuple[int, tuple]]:
    """Runs (sequences, ((length, copies), ...)) that hold every piece of the histogram."""
    bins = _Bins(cap)
    bins.add(0, counts.get(cap, 0), ((cap, 1),))
    large = [(s, n) for s, n in sorted(counts.items(), reverse=True) if cap > s > cap * small_share and n]
    rest = {s: n for s, n in counts.items() if 0 < s <= cap * small_share}
    total = sum(n for _, n in large)
    if total:
        share, pools, filled = -(-total // groups), [[]], 0
        for s, n in large:
            while n:
                take = min(n, share - filled)
                pools[-1].append([s, take])
                n, filled = n - take, filled + take
                if filled == share:
                    pools.append([])
                    filled = 0
        pools = [p for p in pools if p]
        for p in pools:
            p.reverse()  # pop() gives the largest
        merged: dict[int, list[int]] = {}
        for i, p in enumerate(pools):
            merged.setdefault(p[-1][0], []).append(i)
        # a length that fills several groups alone: those groups are one size
        sizes = sorted(merged, reverse=True)
        demand = [sum(n for i in merged[s] for _, n in pools[i]) for s in sizes]
        stock = {s: [x for i in sorted(merged[s], reverse=True) for x in pools[i]] for s in sizes}

        def draw(s: int, n: int) -> list[list[int]]:
            out, pool = [], stock[s]
            while n and pool:
                take = min(n, pool[-1][1])
                out.append([pool[-1][0], take])
                pool[-1][1] -= take
                n -= take
                if not pool[-1][1]:
                    pool.pop()
            return out

        for column, amount in sorted(_configurations(sizes, demand, cap), key=lambda x: -x[1]):
            have = [sum(n for _, n in stock[s]) // c for s, c in zip(sizes, column) if c]
            times = min([int(amount + 1e-6), *have])
            if times <= 0:
                continue
            slots = [draw(s, times) for s, c in zip(sizes, column) for _ in range(c)]
            while times:
                run = min(x[-1][1] for x in slots)
                content: dict[int, int] = {}
                for x in slots:
                    content[x[-1][0]] = content.get(x[-1][0], 0) + 1
                    x[-1][1] -= run
                    if not x[-1][1]:
                        x.pop()
                times -= run
                bins.add(cap - sum(k * v for k, v in content.items()), run, tuple(content.items()))
        for pool in stock.values():
            for s, n in pool:
                rest[s] = rest.get(s, 0) + n
    for s in sorted(rest, reverse=True):
        bins.fit(s, rest[s])
    return [run for runs in bins.runs.values() for run in runs]


def best_plan(counts: dict[int, int], cap: int) -> list[tuple[int, tuple]]:
    """The shortest of a few groupings."""
    floor = -(-sum(s * n for s, n in counts.items()) // cap)
    best = None
    for groups, share in ((24, 1 / 8), (24, 1 / 4), (12, 1 / 8), (40, 1 / 6), (24, 1 / 2)):
        runs = plan(counts, cap, groups, share)
        if best is None or sum(n for n, _ in runs) < sum(n for n, _ in best):
            best = runs
        if sum(n for n, _ in best) == floor:
            break
    return best


def places(runs: list[tuple[int, tuple]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, and for each stretch of ranks its first sequence, copies per sequence and first offset."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for n, content in runs:
        at = 0
        for size, each in content:
            found.setdefault(size, []).append((taken.get(size, 0), first, each, at))
            taken[size] = taken.get(size, 0) + n * each
            at += size * each
        first += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in found.items()}


def pieces(docs: DataFrame, tokenizer_path: str, *, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", style: str = "byte", with_ids: bool = False) -> DataFrame:
    """Encode whole texts (null: empty), append `end_id`, cut those over `cap` so that only the first piece is shorter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path, style)
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = enc.encode(batch.column(1).to_pylist())
                ends, out = np.cumsum(counts), []
                for d, a, b in zip(batch.column(0).to_pylist(), ends - counts, ends):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    at, k = 0, 0
                    stop = len(ids) % cap or cap
                    while at < len(ids):
                        part = ids[at:stop]
                        out.append((d, k, at, len(part), zlib.crc32(part.tobytes()), part.tobytes() if with_ids else None))
                        at, stop, k = stop, stop + cap, k + 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds))[:keep]], names=names[:keep])

    return rows.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(parts: DataFrame, *, cap: int = 2048, share: int = 2_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length at least; a table in the shared folder).

    A length is ranked in shares of about `share` pieces, as many as its count asks for, so that no length is ranked
    in one task. The lengths' counts (`cap` rows at most) go to the driver, and their numbers of shares are broadcast.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(best_plan(counts, cap)) if counts else {}
    shares = F.broadcast(parts.sparkSession.createDataFrame([(s, -(-n // share)) for s, n in counts.items()], "length int, _shares int"))
    salted = parts.join(shares, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_shares")))
    sizes = salted.groupBy("length", "_salt").count()
    firsts = sizes.select("length", "_salt", (F.sum("count").over(W.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_first"))
    # rows that are equal in every column may change places, no others
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", *(c for c in parts.columns if c not in ("doc_id", "piece")))) - 1
    ranked = salted.withColumn("_rank", rank).join(firsts, ["length", "_salt"]).withColumn("_rank", (F.col("_rank") + F.col("_first")).cast("long"))
    names = parts.columns

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = (batch.column(at(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                firsts, sequence, each, offset = where[int(size)]
                run = np.searchsorted(firsts, rank[mine], side="right") - 1
                within = rank[mine] - firsts[run]
                seq[mine] = sequence[run] + within // each[run]
                off[mine] = offset[run] + within % each[run] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", style: str = "byte", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places.

    Defined results: null or empty text is the end id alone; null ids keep their rows; rows that repeat
    are packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    return pack(saved(pieces(docs, tokenizer_path, cap=cap, end_id=end_id, id_col=id_col, text_col=text_col, style=style, with_ids=with_ids), "pieces"), cap=cap)


def sequences(packed: DataFrame) -> DataFrame:
    """Token arrays of the packed sequences (needs pieces with ids): sequence_id, ids (little-endian uint32)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op4_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with byte_bpe_50k, end id 0, in sequences of 2048 tokens."""
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
