"""Lineage cut by written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all tasks run in this process's machine (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def persisted(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: short lineage, survives lost executors.

    With columns ``by``, a filter on them reads its own files only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (a written table of a few narrow columns) marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def tidy(spark: SparkSession, batch: str = "4m") -> Iterator[None]:
    """Within, the shuffle files of a job go when the job is done, as what it makes is written and nothing reads them again, and rows are
    handed to Python in batches of that many bytes, where the session doesn't say otherwise."""
    keys = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": batch}
    changed = {k: v for k, v in keys.items() if spark.conf.get(k, None) is None}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in changed:
            spark.conf.unset(k)
