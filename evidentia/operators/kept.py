"""Tables written to cut a plan: under spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """A new folder for stored tables; without spark.checkpoint.dir only a local master gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="evidentia-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of `df`, written and read back: what follows neither repeats their plan nor carries it along."""
    path = f"{root(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
