"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, matched whole and without regard to case.
TRACKING = ("utm_[^=]*", "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "mc_(cid|eid)", "igshid", "ref", "ref_src", "s_kwcid", "_hs(enc|mi)")
# Shapes of secrets, replaced in this order, and what stands for them.
SECRETS = (
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}\b",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bnpm_[A-Za-z0-9]{16,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[A-Za-z0-9_-]{30,}\b",
    r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{16,}",
)
REDACTED = "[redacted]"
SECRET_NAME = r"(?i)\b([A-Za-z0-9_.-]*(?:key|token|secret|password|passwd|credential)s?[A-Za-z0-9_.-]*)(\s*[\"']?\s*[=:]\s*)"
# A value may be quoted; one that holds a replaced secret already stays as it is.
ASSIGNMENT = SECRET_NAME + (
    r"""("(?![^"\n]*\[redacted\])[^"\n]{8,}"|'(?![^'\n]*\[redacted\])[^'\n]{8,}'|(?![^\s"',;]*\[redacted\])[^\s"',;]{8,})"""
)
CREDENTIALS = r"(?i)\b([a-z][a-z0-9+.-]*://[^/\s:@]+):([^@\s/]+)@"
# Characters that mathematics is written with, and what no name holds.
MATH = r"[0-9=+\-*/^√∫∑∈≤≥→±²³()<>|\\]"
NO_NAME = (r"[=^√∫∑∏∈∉≤≥≠→±≈∞′²³]|\\(frac|sqrt|int|sum)", r"[0-9]\s*[+\-*/·×:^]\s*[0-9]", r"\b[a-zA-Z]['′]?\s*\([^)]*\)")


def content_hash(text: Column, version: str = "") -> Column:
    """sha256 in hex, salted with the extractor's version."""
    return F.concat(F.sha2(text, 256), F.lit(version))


def name_key(name: Column) -> Column:
    """Identity of an entity: lower case, one leading @ off, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^@", ""), r"\s+", " ")


def merge_key(name: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def name_tokens(name: Column) -> Column:
    parts = F.transform(F.split(F.lower(name), r"[^\p{L}\p{N}.]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.filter(parts, lambda t: t != "")


def version_tokens(name: Column) -> Column:
    return F.filter(name_tokens(name), lambda t: t.rlike("[0-9]"))


def capitals(name: Column) -> Column:
    return F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))


def leads_with_punctuation(name: Column) -> Column:
    return F.trim(name).rlike(r"^[^\p{L}\p{N}]")


def schema_name(name: Column) -> Column:
    """snake_case of at most 30 characters."""
    flat = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(flat, "^_+|_+$", ""), 1, 30), "_+$", "")


def normalize_url(url: Column) -> Column:
    """Lower-case host, a path of at least '/', no fragment, no tracking parameters, no trailing '?'."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    base, query = F.split(bare, r"\?", 2)[0], F.coalesce(F.get(F.split(bare, r"\?", 2), F.lit(1)), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({'|'.join(TRACKING)})(=|$)"))
    scheme, rest = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://", 0), F.regexp_replace(base, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^[^/]*", 0)
    path = F.substr(rest, F.length(host) + 1)
    path = F.when((scheme != "") & (path == ""), "/").otherwise(path)
    return F.concat(F.lower(scheme), F.lower(host), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def redact(text: Column) -> Column:
    out = reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), SECRETS, text)
    out = F.regexp_replace(out, ASSIGNMENT, f"$1$2{REDACTED}")
    return F.regexp_replace(out, CREDENTIALS, f"$1:{REDACTED}@")


def secret_hits(text: Column) -> Column:
    """How many secrets redact() takes out, one rule after the other."""
    total, out = F.lit(0), text
    for pattern in SECRETS:
        total, out = total + F.regexp_count(out, F.lit(pattern)), F.regexp_replace(out, pattern, REDACTED)
    total, out = total + F.regexp_count(out, F.lit(ASSIGNMENT)), F.regexp_replace(out, ASSIGNMENT, f"$1$2{REDACTED}")
    return total + F.regexp_count(out, F.lit(CREDENTIALS))


def math_density(text: Column) -> Column:
    """Share of mathematical characters among those and letters; 0 where there is neither."""
    mathish = F.length(F.regexp_replace(text, MATH.replace("[", "[^", 1), ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return mathish.cast("double") / F.greatest(F.lit(1), mathish + letters)


def is_mathematical(text: Column, least: float = 0.25, chars: int = 40) -> Column:
    return F.coalesce((math_density(text) >= least) & (F.length(F.regexp_replace(text, r"\s+", "")) >= chars), F.lit(False))


def plausible_name(name: Column) -> Column:
    """Guards of an entity name: no mathematics, at most 40 characters and 5 words, at least 2 letters."""
    bad = reduce(lambda x, y: x | y, (name.rlike(p) for p in NO_NAME))
    words = F.size(F.split(F.trim(name), r"\s+"))
    return ~bad & (F.length(name) <= 40) & (words <= 5) & (F.length(F.regexp_replace(name, r"[^\p{L}]", "")) >= 2)


def quote_found(source: Column, quote: Column, least: int = 15) -> Column:
    """Whether the quote, of at least so many characters, stands in the source; white space and case don't count.

    The whole source is brought to one form only where two cheaper looks decide nothing: a quote of ASCII that stands there as it is, is
    found; one whose longest run of letters a to z and digits doesn't stand there in either case, is not.
    """
    canon = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    as_it_is = quote.rlike(r"^[\x00-\x7F]*$") & F.contains(source, quote)
    runs = F.transform(F.split(canon(quote), "[^a-z0-9]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    elsewhere = ~F.contains(F.lower(source), F.array_max(runs)["w"])
    full = F.contains(canon(source), canon(quote))
    return F.when(F.length(canon(quote)) < least, False).when(as_it_is, True).when(elsewhere, False).otherwise((F.length(canon(quote)) >= least) & full)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def on_disk(path: Column) -> Column:
    return ~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def inside(path: Column, folder: Column) -> Column:
    """Whether the path lies in the folder; separators as the folder writes them."""
    slash = F.when(F.contains(folder, F.lit("\\")) & ~F.contains(folder, F.lit("/")), F.lit("\\")).otherwise(F.lit("/"))
    return F.startswith(path, F.when(F.endswith(folder, slash), folder).otherwise(F.concat(folder, slash)))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds).cast("int")
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)
    return F.when(s >= 3600, long).otherwise(short)


def first_heading(markdown: Column) -> Column:
    found = F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.trim(found))


def json_array(reply: Column) -> Column:
    """From the first [ to the last ] of a model's reply."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def url_title(url: Column) -> Column:
    """Last path part with - and _ as spaces, or the host."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(bare, "/+$", ""), "[^/]+$", 0), r"\.[A-Za-z0-9]{1,5}$", "")
    only_host = ~F.contains(F.regexp_replace(bare, "/+$", ""), F.lit("/"))
    return F.when(only_host, F.regexp_extract(bare, "^[^/]*", 0)).otherwise(F.translate(last, "-_", "  "))


def keep_citations(text: Column, most: Column) -> Column:
    """Drops [n] where n is not from 1 to ``most``."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1))
    bad = F.filter(marks, lambda m: (m.cast("int") < 1) | (m.cast("int") > most))
    return F.aggregate(bad, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
