"""Model calls by an injected function, and what their replies decide. A reply that can't be read decides nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import json_array

#: The kinds of memory and the length of the longest.
MEMORY_TYPES = ("fact", "preference", "episode", "procedure")
LONGEST = 2000


def completed(prompts: DataFrame, complete: Callable[[list[str]], list[str]], key: str = "id") -> DataFrame:
    """``prompts`` (key, prompt) with each one's reply, by a function of a batch of prompts that runs in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "reply": complete(batch["prompt"].tolist())})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, reply string")


def resolutions(replies: DataFrame) -> DataFrame:
    """(id, candidates, reply) -> (id, verdict: keep_new, keep_both, keep_existing or unsure, winner, reason).

    An existing number that names no candidate means the first; ``unsure`` leaves the conflict pending.
    """
    item = F.get(F.from_json(json_array(F.col("reply")), "array<string>"), F.lit(0))
    rows = replies.withColumn("v", F.when(F.startswith(item, F.lit("{")), F.from_json(item, "verdict string, existing string, reason string")))
    said, number = F.lower("v.verdict"), F.coalesce(F.expr("try_cast(v.existing as double)"), F.lit(1.0))
    names_one = (number == F.floor(number)) & (number >= 1) & (number <= F.size("candidates"))
    place = F.when(names_one, number.cast("int") - 1).otherwise(0)
    reason = F.coalesce("v.reason", F.lit(""))
    known = F.coalesce(said.isin("keep_new", "keep_both", "keep_existing"), F.lit(False))
    why = F.when(F.col("v").isNull(), "unparseable reply").when(~known & (reason == ""), "model did not decide").otherwise(reason)
    return rows.select(
        "id", F.when(known, said).otherwise("unsure").alias("verdict"),
        F.when(said == "keep_existing", F.get("candidates", place)).alias("winner"), why.alias("reason"),
    )


def entity_verdicts(replies: DataFrame) -> DataFrame:
    """(a, b, reply) -> (a, b, verdict: same, distinct or unsure, confidence from 0 to 1, reason); unreadable replies give no row."""
    found = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    rows = replies.withColumn("v", F.from_json(found, "verdict string, confidence string, reason string"))
    sure = F.coalesce(F.expr("try_cast(v.confidence as double)"), F.lit(0.0))
    sure = F.when(F.isnan(sure), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)))
    said = F.lower(F.trim("v.verdict"))
    parsed = rows.select("a", "b", said.alias("verdict"), sure.alias("confidence"), F.trim(F.coalesce("v.reason", F.lit(""))).alias("reason"))
    return parsed.filter(F.col("verdict").isin("same", "distinct", "unsure"))


def distilled(replies: DataFrame) -> DataFrame:
    """(session, chunk, first, last, reply) -> memories (session, chunk, place, type, content, canonical, from_line, to_line).

    Items of another type, without content or with too much of it go; lines outside of the chunk move to its ends.
    """
    items = F.from_json(json_array(F.col("reply")), "array<string>")
    rows = replies.select("session", "chunk", "first", "last", F.posexplode(items).alias("place", "item")).filter(F.col("item").startswith("{"))
    rows = rows.withColumn("v", F.from_json("item", "type string, content string, canonical string, lines array<string>"))
    line = lambda n, default: F.coalesce(F.floor(F.expr(f"try_cast(get(v.lines, {n}) as double)") + 0.5).cast("long"), default)
    inside = lambda c: F.least(F.greatest(c, F.col("first")), F.col("last"))
    rows = rows.withColumn("from_line", inside(line(0, F.col("first"))))
    rows = rows.withColumn("to_line", F.greatest("from_line", inside(line(1, F.col("from_line")))))
    rows = rows.withColumn("content", F.trim("v.content")).filter(F.col("v.type").isin(*MEMORY_TYPES) & (F.length("content").between(1, LONGEST)))
    return rows.select(
        "session", "chunk", "place", F.col("v.type").alias("type"), "content", F.nullif(F.trim("v.canonical"), F.lit("")).alias("canonical"), "from_line", "to_line"
    )
