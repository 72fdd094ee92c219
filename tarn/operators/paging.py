"""Places and running sums over a whole table's order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import persisted


def running(rows: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``rows`` with, for each value, its sum over all rows before in ``order`` (columns that tell all rows apart; nulls first).

    Rows are dealt by ranges of the order; a range adds its own rows, and what the ranges before it sum up to.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.select("*", *(v.alias(f"_{name}") for name, v in values.items())).repartitionByRange(parts, *order)
    dealt = persisted(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(*(F.sum(f"_{name}").alias(f"_all_{name}") for name in values))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = sums.select("_range", *(F.coalesce(F.sum(f"_all_{name}").over(ahead), F.lit(0)).alias(f"_before_{name}") for name in values))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before), "_range")
    out = [(F.col(f"_before_{name}") + F.coalesce(F.sum(f"_{name}").over(within), F.lit(0))).alias(name) for name in values]
    return placed.select(*rows.columns, *out)


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place in the order, from 0."""
    return running(rows, order, **{name: F.lit(1).cast("long")})
