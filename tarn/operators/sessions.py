"""Sessions: packing of transcript units, resuming imports, and where a memory came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HEAD, TAIL = 24_000, 0.6, 0.2
OVERLAP, EXCERPT = 40, 500


def shortened(text: Column, budget: int = BUDGET) -> Column:
    """A text that is too long keeps its head and tail."""
    head, tail = int(budget * HEAD), int(budget * TAIL)
    cut = F.concat(F.substring(text, 1, head), F.lit("\n[...]\n"), F.substr(text, F.length(text) - tail + 1))
    return F.when(F.length(text) > budget, cut).otherwise(text)


def packed_units(units: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Units (session, line, role, text) in chunks of at most ``budget`` characters: (session, chunk, first, last, text)."""
    rows = units.withColumn("text", F.concat(F.col("role"), F.lit(": "), shortened(F.col("text"), budget)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for line, text in group.sort_values("line")[["line", "text"]].itertuples(index=False):
            if out and len(out[-1][2]) + len(text) + 2 <= budget:
                out[-1][1], out[-1][2] = line, f"{out[-1][2]}\n\n{text}"
            else:
                out.append([line, line, text])
        return pd.DataFrame({"session": group["session"].iloc[0], "chunk": range(len(out)), "first": [o[0] for o in out], "last": [o[1] for o in out], "text": [o[2] for o in out]})

    kind = units.schema["session"].dataType.simpleString()
    return rows.groupBy("session").applyInPandas(pack, f"session {kind}, chunk int, first long, last long, text string")


def resume_plan(sessions: DataFrame, ledger: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Where to go on: ``sessions`` (session, lines, prefix_hash at the ledger's offset), ``ledger`` (session, line_offset, ledger_hash).

    new: from 0; up_to_date; resume: ``overlap`` lines before the offset; changed: from 0 again.
    """
    rows = sessions.join(ledger, "session", "left")
    same = F.col("prefix_hash") == F.col("ledger_hash")
    action = (
        F.when(F.col("line_offset").isNull(), "new")
        .when(~same, "changed")
        .when(F.col("line_offset") >= F.col("lines"), "up_to_date")
        .otherwise("resume")
    )
    start = F.when(action == "resume", F.greatest(F.lit(0), F.col("line_offset") - overlap)).when(action == "up_to_date", F.col("lines")).otherwise(0)
    return rows.select("session", action.alias("action"), start.cast("long").alias("from_line"))


def provenance(memories: DataFrame, units: DataFrame, most: int = EXCERPT) -> DataFrame:
    """Excerpt of the lines a memory came from: ``memories`` (id, session, first, last)."""
    inside = F.expr("line between first and last")
    joined = memories.join(units, "session").filter(inside)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    return joined.groupBy("id").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.substring(F.array_join(ordered, "\n"), 1, most).alias("excerpt"))


def daily_calls(calls: DataFrame, budget: int = 200) -> DataFrame:
    """Calls and what is left of the budget per UTC day."""
    return calls.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls")).withColumn("left", F.greatest(F.lit(0), budget - F.col("calls")).cast("long"))
