"""Licence scan with DataFrame functions only: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units of a text are its lines and its paragraphs (between blank lines) that hold a word licences live on (``ANCHOR``), and
the whole text where that holds one and is at most twice as long as the longest template. Templates are headers and whole
texts. A unit's and a template's words weigh (1 + ln tf) * idf, with idf from the templates, and a unit takes the template
of the largest cosine, if that reaches ``THRESHOLD``. A document takes its best unit's licence. It is a licence file if its
name says so, or if its whole text is near to the whole text of a licence; such a file's licence goes to its directory. A
document without a licence of its own inherits that of the nearest directory above it; directories are resolved once each,
not once a file.

Defined cases: null and empty texts have no unit; in texts of any length every line and paragraph is a unit; equal cosines
go to the first licence in order of name, equal units of a directory to the best cosine and then the smallest doc_id; rows
without doc_id have no licence of their own but inherit; rows that repeat a doc_id share the best unit of all of them; a
null path is in no directory; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bounded, persisted
from tarn.llm.license_texts import HEADERS, TEXTS

THRESHOLD = 0.7
#: Distinct directories up to which their licences are broadcast.
FEW = 500_000
ANCHOR = r"(?i)licen[cs]e|copyright|copying|all rights reserved|spdx-|permission is (hereby )?granted|redistribution and use|public domain"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][a-z0-9.-]+)?$"
#: Words of the longest template, twice: a longer text is no licence file, whatever it quotes.
LONGEST = 2 * max(len(re.findall(WORD, t.lower())) for t in TEXTS.values())


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _weights(rows: DataFrame, keys: list[str], idf: DataFrame, other: float) -> DataFrame:
    """``rows`` (keys, terms) -> (keys, term, weight); terms without an idf have that of ``other``."""
    tf = rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    known = tf.join(F.broadcast(idf), "term", "left")
    return known.select(*keys, "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).alias("weight"))


def known_templates(spark: SparkSession) -> DataFrame:
    """(license, template, whole): headers, and whole texts."""
    rows = [(k, t, whole) for whole, texts in ((False, HEADERS), (True, TEXTS)) for k, t in texts.items()]
    return spark.createDataFrame(rows, "license string, template string, whole boolean")


def cosines(units: DataFrame, templates: DataFrame) -> DataFrame:
    """``units`` (doc_id, unit_id, unit) and ``templates`` (license, template, whole), a short table, -> (doc_id, unit_id, license, whole, score).

    Past the words of a unit only its number travels, never its text.
    """
    key = ["license", "whole"]
    named = templates.select(*key, words(F.col("template")).alias("terms"))
    n = named.count()
    idf = named.select(*key, F.explode("terms").alias("term")).distinct().groupBy("term").agg(
        (F.log((n + 1) / (F.count("*") + 1)) + 1).alias("idf")
    )
    other = math.log(n + 1) + 1
    ours = _weights(named, key, idf, other).withColumnRenamed("weight", "t_weight")
    norms = ours.groupBy(*key).agg(F.sqrt(F.sum(F.col("t_weight") * F.col("t_weight"))).alias("t_norm"))
    ours = ours.join(norms, key).groupBy("term").agg(F.collect_list(F.struct(*key, (F.col("t_weight") / F.col("t_norm")).alias("t_weight"))).alias("in"))
    theirs = _weights(units.select("doc_id", "unit_id", words(F.col("unit")).alias("terms")), ["doc_id", "unit_id"], idf, other)
    each = theirs.join(F.broadcast(ours), "term").select("doc_id", "unit_id", "weight", F.explode("in").alias("t"))
    squared = theirs.groupBy("doc_id", "unit_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = each.groupBy("doc_id", "unit_id", "t.license", "t.whole").agg(F.sum(F.col("weight") * F.col("t.t_weight")).alias("dot"))
    return dots.join(squared, ["doc_id", "unit_id"]).select("doc_id", "unit_id", *key, F.round(F.col("dot") / F.col("norm"), 9).alias("score"))


def ancestors(path: Column) -> Column:
    """Directories above a path, from the root ('') down to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(
    docs: DataFrame,
    path: Column,
    templates: DataFrame | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, own (licence of its own), score, license_file, license, licensed_by (its directory if inherited)."""
    spark = docs.sparkSession
    templates = templates or known_templates(spark)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.cast("string").alias("path")
    )
    holds = lambda x: x.rlike(ANCHOR)
    size = F.size(words(F.col("text")))
    parts = F.concat(F.filter(F.split("text", r"\r?\n"), holds), F.filter(F.split("text", r"\r?\n[ \t]*\r?\n"), holds))
    whole = F.when(size <= LONGEST, F.array("text")).otherwise(F.array().cast("array<string>"))
    candidates = rows.filter(holds(F.col("text")) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("of"), F.explode(F.array_distinct(F.concat(parts, whole))).alias("unit")
    )
    candidates = candidates.withColumn("unit_id", F.xxhash64("unit")).withColumn("entire", F.col("unit_id") == F.col("of")).drop("of")
    candidates = persisted(candidates.dropDuplicates(["doc_id", "unit_id", "entire"]), "units")
    found = cosines(candidates.dropDuplicates(["doc_id", "unit_id"]), templates).filter(F.col("score") >= threshold)
    entire = candidates.filter("entire").select("doc_id", "unit_id", "entire").distinct()
    found = found.join(entire, ["doc_id", "unit_id"], "left").withColumn("covers", F.coalesce("entire", F.lit(False)) & F.col("whole"))
    best = found.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"),
        F.min(F.when(F.col("covers"), F.struct((-F.col("score")).alias("minus"), "license"))).alias("file"),
    )
    chosen = F.coalesce("file", "best")  # a licence's whole text tells more than one of its lines
    own = best.select("doc_id", chosen["license"].alias("own"), (-chosen["minus"]).alias("score"), F.col("file").isNotNull().alias("covers"))
    own = persisted(own, "own")
    placed = rows.select("doc_id", "path", F.element_at(ancestors(F.col("path")), -1).alias("dir")).join(own, "doc_id", "left")
    placed = placed.withColumn("license_file", F.col("own").isNotNull() & (F.col("covers") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))))
    placed = persisted(placed.drop("covers"), "placed")
    given = placed.filter("license_file and dir is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "doc_id", "own")).alias("first")
    )
    given = given.select("dir", F.col("first.own").alias("inherited"))
    dirs = placed.filter("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.concat("dir", F.lit("/x")))).alias("depth", "up")).distinct()
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("inherited", "up"), "depth").alias("near")
    )
    nearest = persisted(nearest.select("dir", F.col("near.inherited").alias("inherited"), F.col("near.up").alias("up")), "nearest")
    out = placed.join(bounded(nearest, FEW), "dir", "left")
    return out.select(
        "doc_id",
        "own",
        "score",
        "license_file",
        F.coalesce("own", "inherited").alias("license"),
        F.when(F.col("own").isNull(), F.col("up")).alias("licensed_by"),
    )
