"""Tables whose rows lie in buckets of a key, of which a change rewrites only those it touches.

A version is a manifest, the list of the folder that holds each bucket; it is written last and by creating a file that may not be there,
so readers see a whole version or the one before, and of two writers that start from the same version one fails. What a change
writes grows with the buckets it touches. Old versions stay readable until ``forget`` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer made the version that this one was about to make."""


class Buckets:
    """``by`` deals the rows into ``n`` buckets; ``n`` is kept by the first version and should leave a bucket some 100 MB."""

    def __init__(self, spark: SparkSession, root: str, schema: str, by: list[str], n: int = 64) -> None:
        self.spark, self.root, self.schema, self.by, self.n = spark, root.rstrip("/"), schema, by, n
        if found := self.manifest():
            self.n, self.by, self.schema = found["n"], found["by"], found["schema"]

    def _at(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._at("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        if version is None:
            if not (found := self.versions()):
                return None
            version = found[-1]
        fs, path = self._at(f"manifest-{version:08d}.json")
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"version": version}

    def _read(self, found: dict | None, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in (found or {"buckets": {}})["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n)).cast("int")

    def _change(self, touching: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """The version after ``change`` (rows of the touched buckets -> rows) of the buckets that ``touching`` lies in."""
        found = self.manifest()
        version = found["version"] + 1 if found else 0
        touched = sorted(r[0] for r in touching.select(self.bucket().alias("b")).distinct().collect())  # at most n numbers
        folder = f"data-{version:08d}-{uuid.uuid4().hex[:8]}"
        rows = change(self._read(found, touched)).withColumn("_bucket", self.bucket())
        rows.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        fs, path = self._at(folder)
        here = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(path) if "=" in s.getPath().getName()}
        kept = {b: p for b, p in (found["buckets"] if found else {}).items() if int(b) not in touched}
        text = json.dumps({"n": self.n, "by": self.by, "schema": self.schema, "buckets": kept | {b: f"{folder}/_bucket={b}" for b in here}})
        fs, path = self._at(f"manifest-{version:08d}.json")
        try:
            stream = fs.create(path, False)
        except Exception as error:  # a Java exception's class is known by name only
            if "AlreadyExists" in str(error):
                raise Conflict(f"version {version} of {self.root} is there already") from None
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return version

    def upsert(self, rows: DataFrame, key: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> int:
        """Inserts rows; where the key is there, sets ``update`` (an empty one: all columns to the new row's) if ``where`` holds; None: nothing.

        Expressions name columns as ``old.x`` and ``new.x``. ``key`` holds the columns of ``by``. Of new rows of one key the last in order of all
        columns counts; sum up increments beforehand. Null keys never meet: such rows are always inserted.
        """
        names = [f.name for f in self._read(None).schema]
        last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in names if c not in key] or [F.lit(1)]))
        whole = F.lit(True)
        for k in key:
            whole = whole & F.col(k).isNotNull()
        one = rows.select(*names).withColumn("_n", F.when(whole, last).otherwise(1)).filter("_n = 1").drop("_n")

        def change(held: DataFrame) -> DataFrame:
            old, new = held.withColumn("_there", F.lit(True)).alias("old"), one.withColumn("_there", F.lit(True)).alias("new")
            same = F.lit(True)
            for k in key:
                same = same & (F.col(f"old.{k}") == F.col(f"new.{k}"))
            both = old.join(new, same, "full_outer")
            here, there = F.col("old._there").isNotNull(), F.col("new._there").isNotNull()
            sets = update is not None
            holds = (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) & F.lit(sets)
            value = lambda c: (update or {}).get(c, F.col(f"new.{c}") if update == {} else F.col(f"old.{c}"))
            kinds = {f.name: f.dataType for f in held.schema}
            return both.select(*(
                F.when(here & there & holds, value(c)).when(here, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).cast(kinds[c]).alias(c) for c in names
            ))

        return self._change(one, change)

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """All rows of the ``by`` values in ``rows`` or ``gone`` make way for ``rows``."""
        names = [f.name for f in self._read(None).schema]
        away = rows.select(*self.by)
        away = (away.unionByName(gone.select(*self.by)) if gone is not None else away).distinct()
        return self._change(away, lambda held: held.join(away, self.by, "left_anti").select(*names).unionByName(rows.select(*names)))

    def forget(self, keep: int = 1) -> None:
        """Removes all but the newest ``keep`` versions and the folders that only they named."""
        found = self.versions()
        used = {p.partition("/")[0] for v in found[-keep:] for p in self.manifest(v)["buckets"].values()}
        for v in found[:-keep]:
            fs, path = self._at(f"manifest-{v:08d}.json")
            fs.delete(path, False)
        fs, path = self._at("")
        for status in fs.listStatus(path):
            if status.getPath().getName().startswith("data-") and status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
