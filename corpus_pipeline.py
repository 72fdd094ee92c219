"""A corpus pipeline of five of the training-data operators, each on what the one before it kept.

Documents that are in none of ``LANGUAGES`` by the model's prediction go, then all but one of each group of near
duplicates, then those that hold a benchmark item; personal data is replaced by surrogates under the session's key
(spark.tarn.surrogateKey); the rest is packed into sequences. All stages but the last return the columns of documents.

Defined cases: every stage decides row by row, so rows without a doc_id or with one that repeats are judged by their own
text; null and empty texts have no language and go; texts of any length are read whole; an empty table gives no rows;
further columns, whatever their names, are carried along; of equal rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import decontaminate, language, near_dup, packing, pii
from tarn.llm.common import handed, persisted, surrogate_key, table


#: The languages that the corpus is to hold; None: all that labelled rows tell of.
LANGUAGES: tuple[str, ...] | None = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handed(spark)
    return language.keep_known(docs, LANGUAGES)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handed(spark)
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handed(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handed(spark)
    return pii.with_surrogates(docs, surrogate_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    handed(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", with_surrogates),
    ("packing", packed),
]

#: Naive Bayes, signatures, alignment, keyed permutations and tokens are beyond SQL: tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
