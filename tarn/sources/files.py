"""Text sources: folders of Markdown, text and other files, transcripts, and agents' notes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import content_hash, first_heading

#: kind -> (extensions, version, chunker, bytes -> text)
EXTRACTORS: dict[str, tuple[tuple[str, ...], int, str, Callable[[bytes], str]]] = {}
# Folders that a walk passes over, its depth and most files.
PASSED_OVER = ("node_modules", "dist", "build", "target", "vendor")
DEPTH, MOST_FILES = 5, 500


def register_extractor(kind: str, extensions: tuple[str, ...], version: int, chunker: str, extract: Callable[[bytes], str]) -> None:
    EXTRACTORS[kind] = (tuple(e.lower() for e in extensions), version, chunker, extract)


register_extractor("markdown", (".md", ".markdown"), 2, "markdown", lambda b: b.decode("utf-8", "replace"))
register_extractor("text", (".txt",), 1, "outline", lambda b: b.decode("utf-8", "replace"))


def kind_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (extensions, *_) in EXTRACTORS.items():
        out = F.when(F.lower(path).rlike("(" + "|".join(re.escape(e) for e in extensions) + ")$"), kind).otherwise(out)
    return out


def folder(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` that an extractor knows: (path, mtime, kind, content), hidden and build folders passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.substr("path", F.length(F.regexp_extract("path", f"^.*?{re.escape(root.rstrip('/'))}", 0)) + 1)
    skipped = "|".join(re.escape(p) for p in PASSED_OVER)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), inner.alias("inner"), kind_of(F.col("path")).alias("kind"), "content")
    kept = rows.filter(~F.col("inner").rlike(rf"/\.|/({skipped})/") & F.col("kind").isNotNull() & (F.size(F.split("inner", "/")) - 2 <= DEPTH))
    return kept.drop("inner")


def extracted(files: DataFrame) -> DataFrame:
    """Text, title and versioned hash of each file: (path, mtime, kind, title, content_hash, text)."""
    extractors = dict(EXTRACTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [extractors[k][3](bytes(c)) for k, c in zip(frame["kind"], frame["content"], strict=True)]
            yield frame.drop(columns="content").assign(text=made)

    text = files.select("path", "mtime", "kind", "content").mapInPandas(run, "path string, mtime timestamp, kind string, text string")
    salt = F.lit("")
    for kind, (_, version, *_) in EXTRACTORS.items():
        salt = F.when(F.col("kind") == kind, f"#p{version}").otherwise(salt)
    name = F.regexp_extract("path", r"[^/\\]+$", 0)
    return text.select("path", "mtime", "kind", F.coalesce(first_heading(F.col("text")), name).alias("title"), F.concat(content_hash(F.col("text")), salt).alias("content_hash"), "text")


def transcript_units(lines: DataFrame) -> DataFrame:
    """Lines (session, line, value) of JSON transcripts -> (session, line, role, text); what is no message is skipped."""
    shape = "type string, isSidechain boolean, isMeta boolean, message struct<role:string, content:string>"
    blocks = "array<struct<type:string, text:string>>"
    parsed = lines.select("session", "line", F.from_json("value", shape).alias("v")).filter(
        "v.message is not null and v.type in ('user', 'assistant') and not coalesce(v.isSidechain, false) and not coalesce(v.isMeta, false)"
    )
    listed = F.from_json("v.message.content", blocks)
    joined = F.array_join(F.transform(F.filter(listed, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.trim(F.when(F.col("v.message.content").startswith("["), joined).otherwise(F.col("v.message.content")))
    rows = parsed.select("session", "line", F.coalesce("v.message.role", "v.type").alias("role"), text.alias("text"))
    return rows.filter("text <> '' and not startswith(text, '<command-') and not startswith(text, '<local-command-')")


def prefix_hash(lines: DataFrame, upto: Column) -> DataFrame:
    """sha256 of each session's lines before ``upto``, each closed by a newline: (session, lines, prefix_hash)."""
    kept = lines.filter(F.col("line") < upto)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda s: s["value"])
    return kept.groupBy("session").agg(F.count("*").alias("lines"), F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("prefix_hash"))


def discovered(files: DataFrame, now: Column, days: int = 14, quiet_minutes: int = 5, most: int = 20) -> DataFrame:
    """Transcripts (path, mtime) to import, newest first: named by a UUID, quiet for a while, recent, at most ``most``."""
    uuid = r"/[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.jsonl$"
    fresh = files.filter(F.col("path").rlike(uuid) & (F.col("mtime") <= now - F.make_interval(mins=F.lit(quiet_minutes))) & (F.col("mtime") >= now - F.make_interval(days=F.lit(days))))
    return fresh.orderBy(F.desc("mtime"), "path").limit(most)


def agent_notes(files: DataFrame) -> DataFrame:
    """Notes (path, text) -> (path, name, memory_type, content): front matter first, else ## sections, else the whole."""

    def units(text: str) -> list[tuple[str, str, str]]:
        front = re.match(r"---\n(.*?)\n---\n?(.*)$", text, re.S)
        if front:
            meta = dict(m.groups() for m in re.finditer(r"^[ \t]*(\w+):[ \t]*(.*?)[ \t]*$", front[1], re.M))
            kind = "preference" if meta.get("type") == "feedback" else "fact"
            body = front[2].strip()
            return [(meta.get("name", ""), kind, body)] if body else []
        parts = re.split(r"^##\s+(.+)$", text, flags=re.M)
        if len(parts) > 1:
            return [(n.strip(), "fact", b.strip()) for n, b in zip(parts[1::2], parts[2::2], strict=True) if b.strip()]
        title = re.search(r"^#\s+(.+)$", text, re.M)
        body = re.sub(r"^#\s+.+$", "", text, count=1, flags=re.M).strip()
        return [(title[1].strip() if title else "", "fact", body)] if body else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *u) for p, t in zip(frame["path"], frame["text"], strict=True) if not p.endswith("/MEMORY.md") for u in units(t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "memory_type", "content"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, memory_type string, content string")
