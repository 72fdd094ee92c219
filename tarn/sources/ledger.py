"""Ledgers: tables of parts that are each written once, and leases; both live in a folder that driver and executors share.

A part is a Parquet dataset under a name of its own. It counts as soon as it is complete (_SUCCESS), so work that is cut off and
begun again finds the parts that are done, makes the broken one anew, and ends with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _at(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def has(self, part: str) -> bool:
        fs, path = self._at(f"{part}/_SUCCESS")
        return fs.exists(path)

    def put(self, part: str, rows: DataFrame) -> DataFrame:
        """The part's rows: those written before, or else ``rows``, written now."""
        if not self.has(part):
            rows.write.mode("overwrite").parquet(f"{self.root}/{part}")
        return self.get(part)

    def get(self, *parts: str) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        return read.parquet(*(f"{self.root}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def parts(self, prefix: str = "") -> list[str]:
        """Names of the complete parts, in order."""
        fs, path = self._at("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith(prefix) and self.has(n))

    def read(self, prefix: str = "") -> DataFrame:
        return self.get(*self.parts(prefix))

    def mark(self, name: str) -> None:
        """A mark that other sessions see, such as a wish to stop."""
        fs, path = self._at(f"{name}.mark")
        fs.create(path, True).close()

    def marked(self, name: str) -> bool:
        fs, path = self._at(f"{name}.mark")
        return fs.exists(path)

    def lease(self, name: str, holder: str, now: float, stale: float) -> bool:
        """Whether ``holder`` has the lease from now on: nobody else does, or whoever did took it ``stale`` seconds ago or more.

        Creating the file fails where it exists (on HDFS and local disks this is atomic), so of two who try at once one wins.
        """
        fs, path = self._at(f"{name}.lease")
        if fs.exists(path):
            stream = fs.open(path)
            owner, since = stream.readUTF(), stream.readDouble()
            stream.close()
            if owner == holder:
                return True
            if now - since < stale:
                return False
            fs.delete(path, False)
        try:
            stream = fs.create(path, False)
        except Exception as error:  # a Java exception's class is known by name only
            if "AlreadyExists" in str(error):
                return False
            raise
        stream.writeUTF(holder)
        stream.writeDouble(float(now))
        stream.close()
        return True

    def holder(self, name: str) -> str | None:
        fs, path = self._at(f"{name}.lease")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        owner = stream.readUTF()
        stream.close()
        return owner

    def release(self, name: str, holder: str) -> None:
        if self.holder(name) == holder:
            fs, path = self._at(f"{name}.lease")
            fs.delete(path, False)
