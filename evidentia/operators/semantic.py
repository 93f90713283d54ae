"""A stored semantic index: passages with vectors of a provider and their hash buckets, kept up to date by page fingerprints.

Every change is a version of its own (deltas of pages, passages and buckets under one folder); a page's rows of its latest version
count, older ones go with `compact`. Readers join passages with the pages' latest versions, writers embed changed pages only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import vector
from .kept import kept

BATCH = 64  # texts that a provider is given at once


def embedded(passages: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dim: int) -> DataFrame:
    """passages (any columns, text among them) with vec. A provider that gives another number of vectors, other dimensions or values
    that aren't finite fails the job. Null texts count as empty."""

    def run(parts):
        for part in parts:
            texts, vecs = part["text"].fillna("").tolist(), []
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                got = embed(some)
                if len(got) != len(some) or any(len(v) != dim for v in got) or not np.isfinite(np.asarray(got, float)).all():
                    raise ValueError("the embedding provider gave an invalid result")
                vecs += [[float(x) for x in v] for v in got]
            yield part.assign(vec=pd.Series(vecs, index=part.index, dtype=object))

    plain = passages.drop("vec")
    return plain.mapInPandas(run, StructType([*plain.schema.fields, StructField("vec", ArrayType(DoubleType()))]))


def fingerprints(passages: DataFrame) -> DataFrame:
    """path, fingerprint of every page's passages (path, pos, passage_id, heading, text), in their order."""
    one = F.sha2(F.concat_ws("\0", "passage_id", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    ordered = F.array_sort(F.collect_list(F.struct("pos", one.alias("h"))))
    return passages.groupBy("path").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


class SemanticIndex:
    """The index under a folder. `descriptor` names provider and settings; an index of another one can't be opened."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable, dim: int, descriptor: str, *, tables: int = 10, bits: int = 10, probes: int = 4, seed: str = "lsh"):
        self.spark, self.root, self.embed, self.dim, self.probes = spark, root.rstrip("/"), embed, dim, probes
        self.normals = vector.planes(dim, tables, bits, seed)
        self.descriptor = json.dumps([descriptor, dim, tables, bits, seed])
        found = self._versions().select("descriptor").distinct().filter(F.col("descriptor") != self.descriptor).first()
        if found is not None:
            raise ValueError(f"the index was made by {found[0]}, not by {self.descriptor}")

    def _versions(self) -> DataFrame:
        schema = "version long, base long, descriptor string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/versions")
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self) -> tuple[int, int]:
        """The last version that counts and the first one that it needs."""
        row = self._versions().agg(F.max(F.struct("version", "base")).alias("m")).select("m.*").first()
        return (row["version"], row["base"]) if row["version"] is not None else (0, 1)

    def _read(self, name: str, schema: str) -> DataFrame:
        last, base = self._state()
        paths = [f"{self.root}/{name}/{v}" for v in range(base, last + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pages(self) -> DataFrame:
        """path, fingerprint, version of the pages that are in the index."""
        found = self._read("pages", "path string, fingerprint string, version long")
        return found.groupBy("path").agg(F.max(F.struct("version", "fingerprint")).alias("m")).select("path", "m.fingerprint", "m.version").filter("fingerprint IS NOT NULL")

    def passages(self) -> DataFrame:
        """path, pos, passage_id, heading, text, id, vec."""
        found = self._read("passages", "path string, pos int, passage_id string, heading string, text string, id string, vec array<double>, version long")
        return found.join(self.pages().select("path", "version"), ["path", "version"], "left_semi").drop("version")

    def _buckets(self) -> DataFrame:
        found = self._read("buckets", "path string, id string, table int, sig long, version long")
        return found.join(self.pages().select("path", "version"), ["path", "version"], "left_semi").drop("version")

    def _write(self, pages: DataFrame, passages: DataFrame) -> None:
        last, base = self._state()
        v = last + 1
        number = F.lit(v).cast("long")
        embedded(passages.withColumn("id", F.concat_ws("#", "path", "pos", "passage_id")), self.embed, self.dim).withColumn("version", number).write.mode("overwrite").parquet(f"{self.root}/passages/{v}")
        # from the written rows: a provider isn't asked twice
        rows = self.spark.read.parquet(f"{self.root}/passages/{v}")
        signed = vector.keys(rows, self.normals, 1).join(rows.select("id", "path"), "id")
        signed.select("path", "id", "table", "sig", number.alias("version")).write.mode("overwrite").parquet(f"{self.root}/buckets/{v}")
        pages.select("path", "fingerprint", number.alias("version")).write.mode("overwrite").parquet(f"{self.root}/pages/{v}")
        self._commit(v, base)

    def _commit(self, v: int, base: int) -> None:
        self.spark.createDataFrame([(v, base, self.descriptor)], "version long, base long, descriptor string").coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def _changed(self, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
        # counted, written and joined with the texts: the fingerprints are made once
        wanted = kept(fingerprints(passages))
        return wanted, kept(wanted.join(self.pages().select("path", "fingerprint"), ["path", "fingerprint"], "left_anti"))

    def synchronize(self, passages: DataFrame) -> dict[str, int]:
        """Makes the index that of `passages` (all pages; path, pos, passage_id, heading, text): only changed pages are embedded, pages
        that are no longer there go. Gives the numbers; nothing is written if nothing changed."""
        wanted, changed = self._changed(passages)
        gone = self.pages().join(wanted, "path", "left_anti").select("path", F.lit(None).cast("string").alias("fingerprint"))
        fresh = passages.join(changed.select("path"), "path", "left_semi").select("path", "pos", "passage_id", "heading", "text")
        n = {"reused": wanted.count(), "embedded": changed.count(), "removed": gone.count(), "passages": fresh.count()}
        n["reused"] -= n["embedded"]
        if n["embedded"] or n["removed"]:
            self._write(changed.unionByName(gone), fresh)
        return n

    def upsert(self, passages: DataFrame) -> None:
        """Puts pages in or in place of their older form; others stay."""
        _, changed = self._changed(passages)
        if not changed.isEmpty():
            self._write(changed, passages.join(changed.select("path"), "path", "left_semi").select("path", "pos", "passage_id", "heading", "text"))

    def remove(self, paths: DataFrame) -> None:
        """Takes pages (path) out; unknown ones are passed over."""
        gone = self.pages().join(paths.select("path"), "path", "left_semi").select("path", F.lit(None).cast("string").alias("fingerprint"))
        if not gone.isEmpty():
            self._write(gone, self.passages().limit(0).drop("id", "vec"))

    def compact(self) -> None:
        """One version of what counts; older files are no longer read."""
        v = self._state()[0] + 1
        for name, rows in (("passages", self.passages()), ("buckets", self._buckets()), ("pages", self.pages().drop("version"))):
            rows.withColumn("version", F.lit(v).cast("long")).write.mode("overwrite").parquet(f"{self.root}/{name}/{v}")
        self._commit(v, v)

    def search(self, queries: DataFrame, *, k: int = 10, minimum: float = 0.55) -> DataFrame:
        """qid, path, passage_id, text, score, rank of queries (qid, text): probed buckets, exact cosine, at least `minimum`. Queries have 1
        to 4,096 characters (NFKC isn't applied), k is 1 to 1,000."""
        if not 1 <= k <= 1000:
            raise ValueError("k must be 1 to 1,000")
        squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
        q = queries.select(F.col("qid").alias("id"), squeezed.alias("text"))
        bad = q.filter(F.coalesce(~F.length("text").between(1, 4096) | F.col("text").contains("\0"), F.lit(True))).first()
        if bad is not None:
            raise ValueError(f"query {bad['id']} must have 1 to 4,096 characters")
        asked = embedded(q, self.embed, self.dim).select("id", "vec")
        near = vector.keys(asked, self.normals, self.probes).withColumnRenamed("id", "qid").join(self._buckets(), ["table", "sig"]).select("qid", "id").distinct()
        held = self.passages()
        both = near.join(held.select("id", "vec"), "id").join(asked.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
        best = vector.top(both.select("qid", "id", vector.cosine(F.col("vec"), F.col("qvec")).alias("score")), k, minimum)
        return best.join(held.select("id", "path", "passage_id", "text"), "id").select("qid", "path", "passage_id", "text", "score", "rank")
