"""Incremental maintenance and event windows.

The maintenance functions keep a page table, its postings and its edges in step with a stream of page changes, one
`foreachBatch` call per micro-batch; an incremental state equals a rebuild. Event-time windows are an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, lexical


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts (which needs a zoned timestamp); a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, events, users, total per tumbling window; works on batches and, with a watermark, on streams
    (there the distinct users are an estimate, as streams have no exact distinct count)."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    e = _marked(events, late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), users.alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "events", "users", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, events: events less than `gap` apart."""
    return _marked(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("session_start"), "events")


def last_changes(batch: DataFrame) -> DataFrame:
    """The last change (highest seq) of each path."""
    return batch.withColumn("_rn", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).filter("_rn = 1").drop("_rn")


class Maintained:
    """Pages, postings and metadata edges under one folder, in versions: a version is written whole before the pointer
    moves, so a batch that is repeated after a failure changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("version long, batch long").parquet(f"{self.root}/versions")

    def version(self) -> tuple[int, int]:
        """(version, batch) of the latest state; (0, -1) before the first."""
        try:
            row = self._versions().orderBy(F.desc("version")).first()
        except Exception as e:  # the folder isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["version"], row["batch"]) if row else (0, -1)

    def read(self, name: str) -> DataFrame | None:
        v, _ = self.version()
        return self.spark.read.parquet(f"{self.root}/{name}/v{v}") if v else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Changes: the columns of pages, seq and deleted."""
        v, done = self.version()
        if batch_id <= done:
            return
        changes = last_changes(batch)
        fresh = changes.filter("NOT deleted").drop("seq", "deleted")
        touched = changes.select("path")
        derived = {"pages": (fresh, "path"), "postings": (lexical.postings(fresh), "path"), "edges": (graph.metadata_edges(fresh).withColumn("path", F.substring("src", 6, 1 << 30)), "path")}
        for name, (new, key) in derived.items():
            old = self.read(name)
            out = new if old is None else old.join(touched.withColumnRenamed("path", key), key, "left_anti").unionByName(new)
            out.write.mode("overwrite").parquet(f"{self.root}/{name}/v{v + 1}")
        self.spark.createDataFrame([(v + 1, batch_id)], "version long, batch long").write.mode("append").parquet(f"{self.root}/versions")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies a stream of changes until it is used up."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
