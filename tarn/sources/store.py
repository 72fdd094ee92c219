"""Tables of a store as Parquet snapshots: read, merge by key, write beside and switch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.sources.buckets import Buckets

KINDS = {"status": ("active", "stale"), "memory_type": ("fact", "preference", "episode", "procedure")}


class Store:
    """A folder of tables, each a dataset of snapshots; the newest complete one (with _SUCCESS) counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _snapshots(self, table: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path) if not s.getPath().getName().startswith("data-")]
        return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def buckets(self, table: str, schema: str, by: list[str], n: int = 64) -> Buckets:
        """The table as one of buckets, of which a change rewrites only those it touches."""
        return Buckets(self.spark, f"{self.root}/{table}", schema, by, n)

    def _versions(self, table: str) -> Buckets:
        return Buckets(self.spark, f"{self.root}/{table}", "", [])

    def exists(self, table: str) -> bool:
        return bool(self._snapshots(table)) or bool(self._versions(table).versions())

    def read(self, table: str) -> DataFrame:
        if (found := self._versions(table)).versions():
            return found.read()
        return self.spark.read.parquet(self._snapshots(table)[-1])

    def newest(self, table: str) -> str:
        return self._snapshots(table)[-1]

    def _meta(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_meta.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def meta(self) -> dict:
        """What is kept about the store as a whole."""
        fs, path = self._meta()
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def set_meta(self, meta: dict) -> None:
        fs, path = self._meta()
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """A new snapshot; readers see the old one until it is complete."""
        place = len(self._snapshots(table))
        rows.write.parquet(f"{self.root}/{table}/{place:08d}-{uuid.uuid4().hex[:8]}")
        return self.read(table)

    def upsert(self, table: str, rows: DataFrame, key: list[str], keep: str = "new") -> DataFrame:
        """Insert; of rows with the same key the ``new`` or the ``old`` one stays."""
        return self.write(table, merged(self.read(table), rows, key, keep) if self.exists(table) else merged(rows.limit(0), rows, key, keep))


def merged(old: DataFrame, new: DataFrame, key: list[str], keep: str = "new") -> DataFrame:
    """Union of which one row a key stays; among new rows of a key the last in order of all columns."""
    side = F.col("tarn_new") if keep == "old" else -F.col("tarn_new")
    order = Window.partitionBy(*key).orderBy(side, *[F.desc(c) for c in new.columns if c not in key])
    every = old.withColumn("tarn_new", F.lit(0)).unionByName(new.withColumn("tarn_new", F.lit(1)))
    return every.withColumn("tarn_place", F.row_number().over(order)).filter("tarn_place = 1").drop("tarn_new", "tarn_place")


def checked(rows: DataFrame) -> DataFrame:
    """Rows whose enumerated columns hold allowed values; others fail the job when they are read."""
    for name, allowed in KINDS.items():
        if name in rows.columns:
            bad = F.raise_error(F.concat(F.lit(f"{name} must be one of {allowed}, not "), F.coalesce(name, F.lit("null"))))
            rows = rows.withColumn(name, F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(bad))
    return rows
