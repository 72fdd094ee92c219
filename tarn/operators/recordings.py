"""Recordings: turns, as-of joins of words and turns, overlaps, suspect chunks, sections and speaker names.

Segments are (recording, start, end, speaker), words (recording, start, word), chunks (recording, chunk, start, end).
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import persisted
from tarn.functions.text import clock
from tarn.functions.vectors import nearest

MERGE_GAP, MIN_SPEAKER, SHARE_OF_BIGGEST = 2.0, 8.0, 0.05
TRUNCATED, SUSPECT, MIN_SPEECH = 5.0, 0.5, 8.0
CHUNK_SPAN, CHUNK_GAP, SECTION, SECTION_HARD, SECTION_CHARS = 60.0, 8.0, 120.0, 180.0, 80
VOICE, VOICE_SECONDS = 0.8, 10.0
SLICE = 3600.0


def turns(segments: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """Runs of one speaker with gaps of at most ``gap`` seconds: (recording, turn, speaker, start, end)."""
    order = Window.partitionBy("recording").orderBy("start", "end", "speaker")
    fresh = (F.lag("speaker").over(order) != F.col("speaker")) | (F.col("start") - F.lag("end").over(order) > gap)
    numbered = segments.withColumn("new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("turn", F.sum("new").over(order))
    return numbered.groupBy("recording", "turn").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"))


def relabelled(segments: DataFrame) -> DataFrame:
    """Speakers numbered by first appearance: (recording, speaker, label)."""
    first = segments.groupBy("recording", "speaker").agg(F.min("start").alias("first"))
    return first.select("recording", "speaker", F.row_number().over(Window.partitionBy("recording").orderBy("first", "speaker")).alias("label"))


def roster(segments: DataFrame) -> DataFrame:
    """Talk time and longest segment per speaker, without junk clusters."""
    size = F.col("end") - F.col("start")
    by = segments.groupBy("recording", "speaker").agg(
        F.round(F.sum(size), 6).alias("seconds"), F.round(F.max(size), 6).alias("longest"), F.max_by("start", F.struct(size, -F.col("start"))).alias("sample_at")
    )
    whole = by.groupBy("recording").agg(F.sum("seconds").alias("total"), F.max("seconds").alias("biggest"))
    least = F.least(F.lit(MIN_SPEAKER), 0.1 * F.col("total"))
    kept = by.join(whole, "recording").filter((F.col("seconds") >= least) & (F.col("seconds") >= SHARE_OF_BIGGEST * F.col("biggest")))
    return kept.select("recording", "speaker", "seconds", "longest", "sample_at")


def asof_turns(words: DataFrame, turns_: DataFrame) -> DataFrame:
    """Each word with the last turn that begins at or before it; words before the first turn take the first.

    One sort of the union instead of a range join.
    """
    left = words.select("recording", F.col("start").alias("at"), F.lit(1).alias("kind"), "word", F.lit(None).cast("string").alias("speaker"))
    right = turns_.select("recording", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(words.schema["word"].dataType).alias("word"), "speaker")
    order = Window.partitionBy("recording").orderBy("at", "kind")
    whole = Window.partitionBy("recording").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = left.unionByName(right)
    seen = F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("who", F.coalesce(seen, F.first("speaker", ignorenulls=True).over(whole)))
    return out.filter("kind = 1").select("recording", "at", "word", F.col("who").alias("speaker"))


def overlap_seconds(intervals: DataFrame, speech: DataFrame, width: float = SLICE) -> DataFrame:
    """Seconds of speech inside each interval (recording, id, start, end).

    Cumulative speech at the interval's end less that at its start. Both come from a union of all ends, cut into slices of
    ``width`` seconds: a slice's sums are carried to those after it, and within it points are accumulated in order of time.
    """
    said = speech.filter(F.col("end") > F.col("start"))
    points = said.select("recording", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(
        said.select("recording", F.col("end").alias("at"), F.lit(-1).alias("step"))
    )
    points = points.withColumn("slice", F.floor(F.col("at") / width)).withColumn("part", F.col("at") - F.col("slice") * width)
    asked = intervals.filter(F.col("end") > F.col("start"))
    asked = asked.select("recording", "id", F.col("end").alias("at"), F.lit(1).alias("sign")).unionByName(
        asked.select("recording", "id", F.col("start").alias("at"), F.lit(-1).alias("sign"))
    )
    asked = asked.withColumn("slice", F.floor(F.col("at") / width)).withColumn("part", F.col("at") - F.col("slice") * width)
    # speech up to a slice's begin, and segments open there
    slices = points.groupBy("recording", "slice").agg(F.sum("step").alias("net"), F.sum(F.col("step") * F.col("part")).alias("moment"))
    slices = slices.unionByName(asked.select("recording", "slice", F.lit(0).cast("long").alias("net"), F.lit(0.0).alias("moment")).distinct())
    slices = slices.groupBy("recording", "slice").agg(F.sum("net").alias("net"), F.sum("moment").alias("moment"))
    order = Window.partitionBy("recording").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("open", F.coalesce(F.sum("net").over(before), F.lit(0)))
    step = F.coalesce((F.lead("slice").over(order) - F.col("slice")) * width * (F.col("open") + F.col("net")) - F.col("moment"), F.lit(0.0))
    slices = slices.withColumn("step", step).withColumn("carried", F.coalesce(F.sum("step").over(before), F.lit(0.0)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = intervals.schema["id"].dataType.simpleString()
    every = points.select("recording", "slice", "part", "step", none(kind, "id"), none("int", "sign")).unionByName(
        asked.select("recording", "slice", "part", F.lit(0).alias("step"), "id", "sign")
    )
    inside = Window.partitionBy("recording", "slice").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("net", F.sum("step").over(inside)).withColumn("moment", F.sum(F.col("step") * F.col("part")).over(inside))
    every = every.filter("sign is not null").join(slices.select("recording", "slice", "open", "carried"), ["recording", "slice"])
    until = F.col("carried") + (F.col("open") + F.col("net")) * F.col("part") - F.col("moment")
    sums = every.groupBy("recording", "id").agg(F.sum(F.col("sign") * until).alias("seconds"))
    sums = sums.unionByName(intervals.select("recording", "id", F.lit(0.0).alias("seconds")).distinct())
    return sums.groupBy("recording", "id").agg(F.round(F.greatest(F.lit(0.0), F.sum("seconds")), 6).alias("seconds"))


def truncated_chunks(chunks: DataFrame, words: DataFrame, speech: DataFrame) -> DataFrame:
    """Chunks with five seconds of speech or more after their last word."""
    w = words.select("recording", F.col("start").alias("at"))
    last = chunks.join(w, (chunks.recording == w.recording) & (w["at"] >= chunks.start) & (w["at"] < chunks.end), "left").groupBy(
        chunks.recording, "chunk", chunks.start, chunks.end
    ).agg(F.max(w["at"]).alias("last"))
    tail = last.select("recording", F.col("chunk").alias("id"), F.coalesce("last", "start").alias("start"), "end")
    return overlap_seconds(tail, speech).filter(F.col("seconds") >= TRUNCATED)


def suspect_chunks(rates: DataFrame) -> DataFrame:
    """``rates`` (recording, chunk, words, speech): under half the median rate, of three chunks or more with enough speech."""
    rate = rates.filter(F.col("speech") >= MIN_SPEECH).withColumn("rate", F.col("words") / F.col("speech"))
    listed = rate.groupBy("recording").agg(F.sort_array(F.collect_list("rate")).alias("rates"))
    median = listed.filter(F.size("rates") >= 3).select("recording", F.element_at("rates", (F.floor(F.size("rates") / 2) + 1).cast("int")).alias("median"))
    return rate.join(median, "recording").filter(F.col("rate") < SUSPECT * F.col("median")).select("recording", "chunk", F.round("rate", 6).alias("rate"), F.round("median", 6).alias("median"))


def _fold(rows: DataFrame, out: str, step) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return step(group.sort_values(["start", "end"] if "end" in group else ["start"]))

    return rows.groupBy("recording").applyInPandas(run, out)


def packed_speech(speech: DataFrame, span: float = CHUNK_SPAN, gap: float = CHUNK_GAP) -> DataFrame:
    """Speech segments packed into chunks: a new one when it would span over ``span`` seconds or after a long gap."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for s, e in zip(rows["start"], rows["end"], strict=True):
            if out and e - out[-1][0] <= span and s - out[-1][1] <= gap:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return pd.DataFrame({"recording": rows["recording"].iloc[0], "chunk": range(len(out)), "start": [o[0] for o in out], "end": [o[1] for o in out]})

    kind = speech.schema["recording"].dataType.simpleString()
    return _fold(speech, f"recording {kind}, chunk int, start double, end double", pack)


def sections(words: DataFrame, length: float = SECTION, hard: float = SECTION_HARD) -> DataFrame:
    """Words gathered into sections that end at a sentence after ``length`` seconds, or anywhere after ``hard``."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[float, list[str]]] = []
        for at, word in zip(rows["start"], rows["word"], strict=True):
            if out:
                since = at - out[-1][0]
                if since >= hard or since >= length and out[-1][1][-1][-1:] in ".!?":
                    out.append((at, []))
            else:
                out.append((at, []))
            out[-1][1].append(word)
        return pd.DataFrame({"recording": rows["recording"].iloc[0], "section": range(len(out)), "start": [s for s, _ in out], "text": [" ".join(w) for _, w in out]})

    kind = words.schema["recording"].dataType.simpleString()
    return _fold(words, f"recording {kind}, section int, start double, text string", cut)


def speaker_sections(spoken: DataFrame, least: int = SECTION_CHARS) -> DataFrame:
    """Words with speakers (recording, at, word, speaker) as one section a turn; short ones stay with the section before."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for at, word, who in zip(rows["start"], rows["word"], rows["speaker"], strict=True):
            if not out or who != out[-1][1] and len(" ".join(out[-1][2])) >= least:
                out.append([at, who, []])
            out[-1][2].append(word)
        if len(out) > 1 and len(" ".join(out[-1][2])) < least:
            out[-2][2] += out.pop()[2]
        return pd.DataFrame(
            {"recording": rows["recording"].iloc[0], "section": range(len(out)), "start": [o[0] for o in out], "speaker": [o[1] for o in out], "text": [" ".join(o[2]) for o in out]}
        )

    kind = spoken.schema["recording"].dataType.simpleString()
    return _fold(spoken.withColumnRenamed("at", "start"), f"recording {kind}, section int, start double, speaker string, text string", cut)


def dominant_speakers(spoken: DataFrame, section: Column) -> DataFrame:
    """Most frequent speaker of each section, the one heard first among equals."""
    counts = spoken.withColumn("section", section).groupBy("recording", "section", "speaker").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return counts.groupBy("recording", "section").agg(F.max_by("speaker", F.struct("n", -F.col("first"))).alias("speaker"))


def transcript(sections_: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Markdown of each section under its time and speaker."""
    return sections_.withColumn("markdown", F.concat_ws("\n\n", F.concat(F.lit("## "), clock(F.col("start")), F.lit(" · "), F.col(speaker)), F.col("text")))


def renamed_speaker(chunks: DataFrame, old: str, new: str) -> DataFrame:
    """Headings that end in the speaker's name, and contents that begin with that heading, with the new name."""
    suffix = F.lit(f" · {old}")
    ends = F.endswith(F.col("heading_path"), suffix)
    heading = F.when(ends, F.concat(F.expr(f"left(heading_path, length(heading_path) - {len(old)})"), F.lit(new))).otherwise(F.col("heading_path"))
    content = F.when(
        ends & F.startswith(F.col("content"), F.col("heading_path")), F.concat(heading, F.substr("content", F.length("heading_path") + 1))
    ).otherwise(F.col("content"))
    return chunks.select(*[c for c in chunks.columns if c not in ("heading_path", "content")], heading.alias("heading_path"), content.alias("content"))


def voice_matches(voices: DataFrame, prints: DataFrame, least: float = VOICE) -> DataFrame:
    """Names of unnamed voices (document, speaker, seconds, vec) by known prints (name, vec): best first, each name and voice once.

    The nearest pair goes first, ties to the smaller speaker, then name. A pair that is the best left of both its sides is the next of its
    document wherever it stands, so each round settles all such pairs at once.
    """
    heard = persisted(voices.filter(F.col("seconds") >= VOICE_SECONDS).select(F.col("document").cast("string").alias("src"), "document", F.col("speaker").alias("id"), "vec"), "voices")
    known = persisted(prints.select(F.monotonically_increasing_id().alias("qid"), "name", "vec"), "prints")
    near = nearest(heard, known, max(1, heard.count()), least).join(known.select("qid", "name"), "qid")
    near = near.join(heard.select("src", "document", "id").distinct(), ["src", "id"])
    left = near.groupBy("document", F.col("id").alias("speaker"), "name").agg(F.round(F.max("similarity"), 9).alias("similarity"))
    left, rank, done = persisted(left, "voice-pairs"), F.struct(-F.col("similarity"), "speaker", "name"), None
    while not left.isEmpty():
        first = lambda side: F.min(rank).over(Window.partitionBy("document", side)) == rank
        marked = left.withColumn("one", first("speaker")).withColumn("two", first("name"))
        settled = persisted(marked.filter("one and two").drop("one", "two"), "voice-matches")
        done = settled if done is None else done.unionByName(settled)
        rest = left.join(settled.select("document", "speaker"), ["document", "speaker"], "left_anti").join(settled.select("document", "name"), ["document", "name"], "left_anti")
        left = persisted(rest.select(*settled.columns), "voice-pairs")
    return left if done is None else done


def recording_time(path: Column, container: Column, mtime: Column) -> Column:
    """When a recording was made: a stamp in the file's name, else the container's, else the file's time."""
    stamp = F.regexp_extract(path, r"(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})[T _-]?(\d{2})[-_.:]?(\d{2})", 0)
    digits = F.regexp_replace(stamp, "[^0-9]", "")
    return F.coalesce(F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm"))), container, mtime)
