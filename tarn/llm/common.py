"""What the operators share: bounded broadcasts, text batches, and the engine's tables and checkpoints."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.checkpoints import persisted, shared_dir
from tarn.tables import table

__all__ = ["SLICE", "bounded", "handed", "persisted", "shared_dir", "slices", "surrogate_key", "table", "texts"]


#: Bytes of text at a time where each byte takes some dozens of bytes of arrays.
SLICE = 512 << 10
#: Bytes of rows that a task hands to its Python worker at a time; Spark's default lets 10,000 long texts pile up on both sides.
HANDED = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, rows: int = 4_000_000) -> DataFrame:
    """``df`` (a written table of a few narrow columns) marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def handed(spark: SparkSession) -> None:
    """From now on this session's tasks hand rows to Python in batches of about ``HANDED`` bytes (a longer row comes alone), unless it says how many.

    It stays set, as Spark reads it when a query is run. Results don't depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(HANDED))


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the PII surrogates, from the session; without one, a key that is public and fit for tests only."""
    return spark.conf.get("spark.tarn.surrogateKey", "public key of tests").encode()


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer row comes alone); idle workers keep no memory."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, lengths
    give_back()


def give_back() -> None:
    """Freed memory of this worker to the system: workers live on between tasks and stages, next to each other in one executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def texts(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The column as str, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
