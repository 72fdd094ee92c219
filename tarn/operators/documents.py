"""Documents: sectioning and splitting, ingest outcomes, chunk reuse, folders, HTML to text, and PDF reading order.

Splitters are folds over one document and run as small functions inside mapInPandas; everything else is set-based.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import bounded
from tarn.functions.text import basename, inside, on_disk

TARGET, MAXIMUM, OVERLAP = 1600, 2048, 200
SECTION_MAX, SECTION_TARGET = 16_000, 8_000
DEBRIS = 25
THIN_TEXT, LARGE_HTML = 800, 100 * 1024
SEPARATORS = (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r" ")


def _pieces(text: str, most: int, level: int = 0) -> list[str]:
    """Parts of at most ``most`` characters: a part that is too long is split by the next finer separator."""
    if len(text) <= most:
        return [text]
    while level < len(SEPARATORS):
        parts = [p for p in re.split(SEPARATORS[level], text) if p.strip()]
        if len(parts) > 1:
            return [x for p in parts for x in _pieces(p, most, level + 1)]
        level += 1
    return [text[i : i + most] for i in range(0, len(text), most)]


def chunk_text(text: str, target: int = TARGET, most: int = MAXIMUM, overlap: int = OVERLAP) -> list[str]:
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    merged: list[str] = []
    for piece in _pieces(text, most):
        if merged and len(merged[-1]) + len(piece) + 1 <= target:
            merged[-1] += "\n" + piece
        else:
            merged.append(piece)
    out = merged[:1]
    for before, chunk in zip(merged, merged[1:], strict=False):
        tail = before[-overlap:] if overlap else ""
        if tail.find(" ") > 0:
            tail = tail[tail.find(" ") + 1 :]
        out.append(f"{tail.lstrip()}\n{chunk}" if tail.strip() else chunk)
    return out


def chunk_markdown(text: str) -> list[tuple[str, str]]:
    """(heading path, chunk): one section each, long ones split without overlap."""
    sections: list[tuple[str, list[str]]] = [("", [])]
    stack: list[tuple[int, str]] = []
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.strip().startswith(("```", "~~~"))
        heading = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*$", line)
        if heading:
            stack = [s for s in stack if s[0] < len(heading[1])] + [(len(heading[1]), heading[2])]
            sections.append((" > ".join(t for _, t in stack), []))
        else:
            sections[-1][1].append(line)
    out = []
    for path, lines in sections:
        if body := "\n".join(lines).strip():
            parts = [body] if len(body) <= SECTION_MAX else chunk_text(body, SECTION_TARGET, SECTION_TARGET, 0)
            out += [(path, f"{path}\n\n{p}" if path else p) for p in parts]
    return out


def _is_title(line: str) -> bool:
    """A line of capitals, of 4 to 120 characters and at least 4 letters."""
    bare = line.strip()
    return 4 <= len(bare) <= 120 and sum(map(str.isalpha, bare)) >= 4 and not any(map(str.islower, bare))


def _keyword(rest: str) -> str:
    """Up to four leading tokens of capitals or digits after a point's number; the first is a word of at least three."""
    bare = lambda t: re.sub("[.,]$", "", t)
    tokens = list(takewhile(lambda t: bare(t) and all(c.isupper() or c.isnumeric() for c in bare(t)), rest.split()[:4]))
    joined = " ".join(tokens)
    return joined if tokens and len(bare(tokens[0])) >= 3 and any(map(str.isupper, tokens[0])) and len(joined) <= 40 else ""


def chunk_outline(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, chunk): numbered points under titles in capitals; a chunk begins with its breadcrumb and keeps its number."""
    title, sections, fresh = "", [], True
    for line in text.splitlines():
        point = re.match(r"\s*(\d{1,3})[.)]\s+(?=\S)", line)
        if _is_title(line):
            title, fresh = re.sub(r"\s+", " ", line.strip()), True
        elif point:
            sections.append([title, f"{point[1]}. {_keyword(line[point.end() :])}".strip(), [line]])
            fresh = False
        else:
            if fresh:
                sections.append([title, "", []])
                fresh = False
            sections[-1][2].append(line)
    kept = [(" > ".join(filter(None, s[:2])), "\n".join(s[2])) for s in sections if "".join(s[2]).strip()]
    if len(kept) > 1:
        kept = [s for s in kept if s[0] or len(s[1].strip()) >= DEBRIS]
    return [(path, f"{path}\n\n{piece}" if path else piece) for path, body in kept for piece in chunk_text(body)]


SPLITTERS: dict[str, Callable[[str], list[tuple[str, str]]]] = {
    "text": lambda t: [("", c) for c in chunk_text(t)],
    "markdown": chunk_markdown,
    "outline": chunk_outline,
}


def chunks(docs: DataFrame, splitter: str | Callable[[str], list[tuple[str, str]]] = "text") -> DataFrame:
    """``docs`` (id, text) -> (id, chunk_index, heading_path, content)."""
    split = SPLITTERS[splitter] if isinstance(splitter, str) else splitter

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, p, c) for i, t in zip(frame["id"], frame["text"], strict=True) for k, (p, c) in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "heading_path", "content"])

    return docs.select("id", "text").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, chunk_index int, heading_path string, content string")


def reuse_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset match of chunks by content within a document: (document, action keep/doom/fresh, old_index, new_index)."""
    key = ["document", "content"]
    count = lambda df, name: df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("chunk_index"))).withColumnRenamed("chunk_index", name)
    both = count(old, "old_index").join(count(new, "new_index"), [*key, "n"], "full_outer")
    action = F.when(F.col("new_index").isNull(), "doom").when(F.col("old_index").isNull(), "fresh").otherwise("keep")
    return both.select("document", action.alias("action"), "old_index", "new_index")


def without_chunk_edges(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Edges that neither come from a doomed chunk nor were stated by one."""
    left = edges.join(doomed.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return left.join(doomed.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def ingest_outcomes(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """What adding each path does: unchanged, updated, converted, exists or added. Rows are (path, content_hash)."""
    upload = lambda c: c.startswith("upload://")
    prior = known.select("path", F.col("content_hash").alias("prior"))
    by_hash = known.groupBy("content_hash").agg(
        F.bool_or(upload(F.col("path"))).alias("hash_upload"), F.bool_or(F.lit(True)).alias("hash_any")
    )
    named = known.withColumn("base", F.lower(basename(F.col("path")))).groupBy("base").agg(
        F.bool_or(upload(F.col("path"))).alias("name_upload"), F.bool_or(~upload(F.col("path"))).alias("name_linked")
    )
    rows = incoming.withColumn("base", F.lower(basename(F.col("path"))))
    rows = rows.join(prior, "path", "left").join(by_hash, "content_hash", "left").join(named, "base", "left")
    new, up, http = F.col("prior").isNull(), upload(F.col("path")), F.col("path").rlike("^https?://")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(~new & (F.col("prior") == F.col("content_hash")), "unchanged")
        .when(~new, "updated")
        .when(~up & yes("hash_upload"), "converted")
        .when(~up & ~http & yes("name_upload"), "converted")
        .when(up & (yes("hash_any") | yes("name_linked")), "exists")
        .otherwise("added")
    )
    return rows.select("path", outcome.alias("outcome"))


def listed(docs: DataFrame) -> DataFrame:
    """Documents with whether they can be watched: they lie on disk."""
    return docs.withColumn("watchable", on_disk(F.col("path")))


def under_roots(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents per root: each path's ancestor folders are exploded, so the range join is an equi join."""
    parts = F.split("path", "/")
    above = docs.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    hits = above.join(bounded(roots.select(F.regexp_replace("root", "/+$", "").alias("root"))), "root")
    return roots.select(F.regexp_replace("root", "/+$", "").alias("root")).join(hits.groupBy("root").agg(F.count("*").alias("documents")), "root", "left").select(
        "root", F.coalesce("documents", F.lit(0)).alias("documents")
    )


def in_folder(docs: DataFrame, folder: str) -> DataFrame:
    return docs.filter(inside(F.col("path"), F.lit(folder)))


def file_changes(known: DataFrame, seen: DataFrame, last_scan: Column) -> DataFrame:
    """(path, change): missing (known, not on disk), fresh (not known), changed (newer than the last walk's start)."""
    both = known.select("path", F.lit(True).alias("known")).join(seen.select("path", "mtime"), "path", "full_outer")
    change = F.when(F.col("mtime").isNull(), "missing").when(F.col("known").isNull(), "fresh").when(F.col("mtime") > last_scan, "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def link_outcome(html_bytes: Column, text_chars: Column, content_type: Column) -> Column:
    """ok, or the code of what is wrong with a fetched page."""
    return (
        F.when(html_bytes > 10 * 1024 * 1024, "too_large")
        .when(~content_type.rlike("(?i)html"), "not_html")
        .when(text_chars == 0, "empty")
        .when((html_bytes > LARGE_HTML) & (text_chars < THIN_TEXT), "thin")
        .otherwise("ok")
    )


class Article(HTMLParser):
    """Markdown of a page's <article> (or body): headings, paragraphs, list items; scripts, styles and navigation left out."""

    SKIP = frozenset(("script", "style", "nav", "head", "aside", "footer", "noscript"))
    BLOCK = frozenset(("p", "div", "li", "br", "tr", "section", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"))

    def __init__(self, only_article: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.only, self.depth, self.skip, self.out = only_article, 0, 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag == "article"
        self.skip += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag == "article" and self.depth > 0
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip and (self.depth or not self.only):
            self.out.append(re.sub(r"\s+", " ", data))


def article_text(html: str) -> str:
    parser = Article("<article" in html.lower())
    parser.feed(html)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
    return re.sub(r"\n{2,}", "\n\n", text).strip()


def articles(pages: DataFrame) -> DataFrame:
    """``pages`` (id, html) -> (id, markdown)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "markdown": [article_text(h or "") for h in frame["html"]]})

    return pages.select("id", "html").mapInPandas(run, f"id {pages.schema['id'].dataType.simpleString()}, markdown string")


def reading_order(items: DataFrame, width: float) -> DataFrame:
    """Lines of positioned text (document, page, x, y, w, text; y grows upwards) in reading order: (document, page, line, text).

    A page has two columns if a gap of 4 % of the width lies between 30 and 70 % and each side has at least 4 of 8 or more items.
    """

    def order(page: pd.DataFrame) -> pd.DataFrame:
        split = 0.0
        if len(page) >= 8:
            edges = sorted(zip(page["x"], page["x"] + page["w"], strict=True))
            right = edges[0][1]
            for x, end in edges[1:]:
                middle = (right + x) / 2
                sides = int((page["x"] + page["w"] <= middle).sum()), int((page["x"] >= middle).sum())
                if x - right >= 0.04 * width and 0.3 * width <= middle <= 0.7 * width and min(sides) >= 4:
                    split = middle
                    break
                right = max(right, end)
        rows = page.assign(column=(page["x"] >= split).astype(int) if split else 0, base=page["y"].round(0))
        rows = rows.sort_values(["column", "base", "x"], ascending=[True, False, True])
        lines = rows.groupby(["column", "base"], sort=False)["text"].agg(" ".join)
        return pd.DataFrame({"document": page["document"].iloc[0], "page": page["page"].iloc[0], "line": range(len(lines)), "text": lines.to_list()})

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in ("document", "page"))
    return items.groupBy("document", "page").applyInPandas(order, f"{kinds}, line int, text string")
