"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are quantised to integers. Of each vector and each resolution the sums and the deviations of
its segments are kept; |q - x|^2 is at least the sum over segments of length * ((mean gap)^2 +
(deviation gap)^2), so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most the sum of length * (mean
product + deviation product). Resolutions go from coarse to fine; what stays above the running
k-th best score gets its exact score.

Queries are written once in blocks to the shared folder; each task streams them past a few blocks of
candidates that it holds, and each block's scores raise the floor for the next one. A first pass over a fixed number of candidates gives
each query a score its k-th best can't be under; it only prunes, and can't change results.

Defined results: null vectors and vectors with null or non-finite components take no part; rows that
repeat a vec_id are candidates each for themselves, and a query's own row is every row with its id; null
ids are candidates never returned (they have no id to give) and never queries; empty tables give no rows;
vectors of another length than the query take no part for it; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import file_system, publish, saved, scratch, table

#: Blocks of candidates that a task holds while the queries go past.
HELD = 8
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, v (integer components) of the vectors that take part."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    ok = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd))
    return ok.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def levels(dim: int) -> list[int]:
    """Segment lengths from coarse to fine: about dim/4, then halves down to 4."""
    out, n = [], max(1, dim // 4)
    while n >= 4:
        out.append(n)
        n //= 2
    return out


def statistics(v: np.ndarray, length: int) -> np.ndarray:
    """Rows whose inner products bound those of `v`'s rows from above: scaled means, then scaled deviations."""
    n, dim = v.shape
    full = dim // length * length
    parts = [v[:, :full].reshape(n, -1, length)] if full else []
    means, devs = [], []
    for p in parts:
        m = p.mean(2)
        means.append(m * np.sqrt(length))
        devs.append(np.sqrt(np.maximum((p * p).sum(2) - m * m * length, 0)))
    if full < dim:
        tail = v[:, full:]
        m = tail.mean(1, keepdims=True)
        means.append(m * np.sqrt(dim - full))
        devs.append(np.sqrt(np.maximum((tail * tail).sum(1, keepdims=True) - m * m * (dim - full), 0)))
    return np.concatenate(means + devs, 1)


def kind_for(q: np.ndarray, x: np.ndarray):
    """The fastest type in which every inner product of the blocks is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64


def search_block(qid, q, floor, xid, x, k, dense: float = 0.05):
    """(query row, candidate row, score) of every candidate that can be among a query's k best of this block, given
    that scores under `floor` can't be.

    Bounds are widened against rounding. While over the share `dense` of the pairs stays, a resolution is taken as
    one matrix product; once less stays, the finer resolutions and the exact scores look at the pairs left. Where no
    resolution gets under that share, the exact scores of the survivors come from one product too.
    """
    kind = kind_for(q, x)
    near = np.ones((len(q), len(x)), bool)
    rows = cols = None
    for length in levels(q.shape[1]):
        a, b = statistics(q.astype(np.float32), length), statistics(x.astype(np.float32), length)
        slack = 1e-5 * float(np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))) + 1e-3
        if rows is None:
            near &= a @ b.T >= (floor - slack).astype(np.float32)[:, None]
            if np.count_nonzero(near) <= dense * near.size:
                rows, cols = np.nonzero(near)
        else:
            keep = np.einsum("ij,ij->i", a[rows], b[cols]) >= floor[rows] - slack
            rows, cols = rows[keep], cols[keep]
    if rows is None:
        score = q.astype(kind) @ x.astype(kind).T
        rows, cols = np.nonzero(near & (score >= floor[:, None]))
        score = score[rows, cols].astype(np.int64)
    else:
        score = np.einsum("ij,ij->i", q[rows].astype(kind), x[cols].astype(kind)).astype(np.int64)
    keep = (score >= floor[rows]) & (qid[rows] != xid[cols])
    rows, cols, score = rows[keep], cols[keep], score[keep]
    order = np.lexsort((xid[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[best], cols[best], score[best]


def _vectors(batch):
    """{dim: (ids, matrix)} of an Arrow batch of vec_id, v."""
    v = batch.column(1)
    sizes = np.diff(v.offsets.to_numpy())
    flat, ids = v.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
    ends = np.cumsum(sizes)
    out = {}
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        out[int(dim)] = (ids[mine], flat[(ends[mine] - dim)[:, None] + np.arange(dim)])
    return out


def top_k(queries: DataFrame, vectors: DataFrame, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048, probe: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    root = scratch(spark, "query-blocks")
    q = quantised(queries, id_col, vec_col, scale)
    x = saved(quantised(vectors, id_col, vec_col, scale), "quantised")
    # a bounded sample that only sets each query's first lower bound
    sample = x.limit(probe).toPandas()
    seed: dict[int, tuple] = {}
    for dim, part in sample.groupby(sample["v"].map(len)) if len(sample) else ():
        seed[int(dim)] = (part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()))

    def write(batches):
        import pyarrow as pa

        made = []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                for dim, (ids, m) in _vectors(batch.slice(at, block)).items():
                    floor = np.full(len(ids), -(2.0**62))
                    if dim in seed:
                        sid, sm = seed[dim]
                        for lo in range(0, len(ids), 256):
                            scores = m[lo : lo + 256].astype(np.float64) @ sm.T.astype(np.float64)
                            scores[ids[lo : lo + 256][:, None] == sid[None, :]] = -np.inf
                            if len(sid) > k:
                                kth = np.partition(scores, len(sid) - k, axis=1)[:, len(sid) - k]
                                floor[lo : lo + 256] = np.where(np.isfinite(kth), kth - np.abs(kth) * 1e-9, -(2.0**62))
                    data = io.BytesIO()
                    np.savez(data, ids=ids, m=m, floor=floor)
                    name = f"{dim}-{uuid.uuid4().hex}.npz"
                    publish(root, name, data.getvalue())
                    made.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["file"])

    files = [r["file"] for r in q.mapInArrow(write, "file string").collect()]

    def scan(batches):
        import pyarrow as pa

        fs, path = file_system(root)

        def against(held):
            """The k best of the held blocks for every query; each block raises the floor for the next one."""
            for name in files:
                dim = int(name.split("-")[0])
                mine = [x[dim] for x in held if dim in x]
                if not mine:
                    continue
                with fs.open_input_file(f"{path}/{name}") as f:
                    asked = np.load(io.BytesIO(f.read()))
                ids, m, floors = asked["ids"], asked["m"], asked["floor"]
                for lo in range(0, len(ids), 512):
                    qid, q, floor = ids[lo : lo + 512], m[lo : lo + 512], floors[lo : lo + 512].copy()
                    rows, found, score = (np.zeros(0, np.int64) for _ in range(3))
                    for xid, xm in mine:
                        r, c, s = search_block(qid, q, floor, xid, xm, k)
                        rows, found, score = np.append(rows, r), np.append(found, xid[c]), np.append(score, s)
                        order = np.lexsort((found, -score, rows))
                        rows, found, score = rows[order], found[order], score[order]
                        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                        best = place < k
                        kth = place == k - 1
                        floor[rows[kth]] = np.maximum(floor[rows[kth]], score[kth].astype(np.float64) * (1 - 1e-9 * np.sign(score[kth])))
                        rows, found, score = rows[best], found[best], score[best]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        held = []
        for whole in batches:
            for at in range(0, whole.num_rows, 2 * block):
                held.append(_vectors(whole.slice(at, 2 * block)))
                if len(held) == HELD:
                    yield from against(held)
                    held = []
        yield from against(held)

    hits = x.mapInArrow(scan, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best for every vector whose id is divisible by 20, of all other vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, sum(q.c * x.c)::BIGINT AS score FROM u q JOIN u x ON q.i = x.i AND q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
