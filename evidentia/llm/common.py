"""Shared helpers of the training-data operators.

Scratch tables live under ``spark.checkpoint.dir``, the one folder that the
driver and all executors share. A folder of our own is set only where that
setting is absent (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while an operator's tables are written: whole texts are several KB each, and a batch is held
#: by the JVM and by Python at the same time.
ARROW_ROWS = 2000
#: Bytes of such a batch at which it is closed before it has ARROW_ROWS rows (one row may hold more).
ARROW_BYTES = 16 << 20
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared scratch folder (no trailing slash). Without one, only a local master gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            root = made.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="evidentia-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root.rstrip("/")
    return root if "://" in root or root.startswith("file:") else "file://" + root


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty path under the shared folder."""
    return f"{shared_root(spark)}/evidentia/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of ours."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        before[key] = spark.conf.get(key, None)
        now = int(before[key]) if before[key] and before[key].isdigit() else 0
        spark.conf.set(key, str(min(now, most) if now > 0 else most))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """The scratch tables of one call of an operator. They are deleted once the call's result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, scratch(spark, name), 0
        self.latest: dict[str, str] = {}

    def saved(self, df: DataFrame, name: str, *, over: bool = False) -> DataFrame:
        """As `saved`; with `over`, the table saved before under this name is deleted (nothing else may read it)."""
        self.made += 1
        path = f"{self.base}/{self.made:03d}-{name}"
        out = saved(df, name, path)
        if over and name in self.latest:
            deleted(self.spark, self.latest[name])
        self.latest[name] = path
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result outside of the workspace, which ends with it."""
        out = saved(df, name)
        self.close()
        return out

    def close(self) -> None:
        deleted(self.spark, self.base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.array_remove(parts, "")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def file_system(uri: str):
    """(pyarrow file system, path) of a shared URI; Hadoop's one-slash ``file:/x`` is accepted."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then move it into place: readers never see half a file."""
    fs, base = file_system(uri)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{base}/{name}")
