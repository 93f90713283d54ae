"""Random-hyperplane LSH with multi-probe and exact cosine re-scoring."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _uniform(seed: int, n: int) -> np.ndarray:
    """n values in [0, 1) of a 32-bit generator (the additive constant and shifts are fixed by the index format)."""
    i = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
    low = np.uint64(0xFFFFFFFF)
    t = ((i ^ (i >> np.uint64(15))) * (i | np.uint64(1))) & low
    t = t ^ ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & low)) & low)
    return ((t ^ (t >> np.uint64(14))) & low) / 4294967296.0


def planes(dim: int, tables: int = 10, bits: int = 10, seed: str = "lsh") -> np.ndarray:
    """[tables, bits, dim] unit normals, float32, the same for the same seed."""
    out = np.zeros((tables, bits, dim), np.float32)
    for t in range(tables):
        first = int.from_bytes(hashlib.sha256(f"{seed}\0{t}".encode()).digest()[:4], "little")
        p = (_uniform(first, bits * dim) * 2 - 1).reshape(bits, dim)
        out[t] = p / np.linalg.norm(p, axis=1, keepdims=True)
    return out


def keys(vectors: DataFrame, normals: np.ndarray, probes: int) -> DataFrame:
    """id, table, sig: with probes=1 a vector's own buckets; else also those over its nearest planes, one bit each."""
    tables, bits, dim = normals.shape
    flat = normals.reshape(tables * bits, dim).astype(np.float64)
    weight = 1 << np.arange(bits)

    def sign(parts):
        for part in parts:
            part = part[part["vec"].map(lambda v: v is not None and len(v) == dim)]
            if part.empty:
                continue
            m = np.stack(part["vec"].to_numpy()).astype(np.float32).astype(np.float64)
            proj = (m @ flat.T).reshape(len(m), tables, bits)
            own = (proj >= 0) @ weight
            near = np.argsort(np.abs(proj), axis=2, kind="stable")[:, :, : probes - 1]
            sigs = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << near)], 2)
            n = sigs.shape[2]
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), tables * n), "table": np.tile(np.repeat(np.arange(tables), n), len(m)).astype(np.int32), "sig": sigs.ravel().astype(np.int64)})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vec").mapInPandas(sign, f"id {kind}, table int, sig long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, -1.0).otherwise(dot(a, b) / norm)


def top(scored: DataFrame, k: int, minimum: float) -> DataFrame:
    """qid, id, score, rank from (qid, id, score), rounded to six places before ranking; NaN never ranks."""
    s = scored.withColumn("score", F.round("score", 6)).filter(~F.isnan("score") & (F.col("score") >= minimum))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def candidates(vectors: DataFrame, queries: DataFrame, normals: np.ndarray, probes: int = 4) -> DataFrame:
    """Distinct qid, id that share a probed bucket: an equi-join on (table, sig)."""
    return keys(queries, normals, probes).withColumnRenamed("id", "qid").join(keys(vectors, normals, 1), ["table", "sig"]).select("qid", "id").distinct()


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, minimum: float = 0.55, tables: int = 10, bits: int = 10, probes: int = 4, seed: str = "lsh", dim: int = 64) -> DataFrame:
    """Approximate top k of each query vector (columns id, vec on both sides)."""
    near = candidates(vectors, queries, planes(dim, tables, bits, seed), probes)
    both = near.join(vectors, "id").join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
    return top(both.select("qid", "id", cosine(F.col("vec"), F.col("qvec")).alias("score")), k, minimum)


def exact(vectors: DataFrame, queries: DataFrame, *, k: int = 10, minimum: float = -1.0, most_queries: int = 1000) -> DataFrame:
    """Brute force for a stated set of query vectors: broadcast if their counted number is at most `most_queries`; beyond it
    they are dealt in blocks of that many, and every vector meets every block by an equi-join on the block's number."""
    # norms once for each vector, not for each pair
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), norm("vec").alias("_qn"))
    vectors = vectors.select("id", "vec", norm("vec").alias("_n"))
    n = q.count()
    if n <= most_queries:
        both = vectors.crossJoin(F.broadcast(q))
    else:
        blocks = -(-n // most_queries)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        both = vectors.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long")).join(q.withColumn("_block", block("qid")), "_block")
    score = F.when(F.col("_n") * F.col("_qn") == 0, -1.0).otherwise(dot(F.col("vec"), F.col("qvec")) / (F.col("_n") * F.col("_qn")))
    return top(both.select("qid", "id", score.alias("score")), k, minimum)
