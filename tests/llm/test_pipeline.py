"""The corpus pipeline: each stage's decisions take effect, and clean documents stay."""

import pyarrow as pa

import corpus_pipeline
from tarn.llm.common import BATCH_BYTES, HANDED, persisted


def test_stages(spark, tmp_path):
    rows = [
        (0, "the quick brown fox jumps over the lazy dog near the river bank today", "en"), (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (2, "12345 !!! 678", "en"), (3, "some words before alpha beta gamma delta epsilon zeta eta theta iota kappa and after", "en"),
        (4, "write to jo.doe@mail.example.com please about this other matter", "en"), (5, None, None),
    ]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    item.write.parquet(str(tmp_path / "benchmark.parquet"))
    left, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        left = persisted(stage(spark, left, str(tmp_path)), name)
        kept.append(sorted({r.doc_id for r in left.select("doc_id").collect()}))
        if name != "packing":
            assert left.columns == docs.columns
        if name == "pii":
            assert "jo.doe" not in left.filter("doc_id = 4").first().text
    assert kept == [[0, 1, 3, 4], [0, 3, 4], [0, 4], [0, 4], [0, 4]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left.count()


def written(spark, folder, rows, item):
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), "r", 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, row_0 int")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return docs


def test_odd_rows(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (7, "12345", "en"), (7, "a clean text under the same id as one without letters", "en"), (7, f"here {item} there", "en"),
        (None, "a clean text that has no id at all and stays", "en"), (None, f"no id and {item} in it", "en"), (None, "999", None),
        (8, "one and the same row is given twice in this table", "en"), (8, "one and the same row is given twice in this table", "en"),
        (9, "long " * 60_000, "en"), (10, "", "en"), (11, None, "en"),
    ]
    docs = written(spark, tmp_path, rows, item)
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = persisted(stage(spark, left, str(tmp_path)), name)
        assert left.schema == docs.schema
    assert sorted((str(r.doc_id), r.text[:9]) for r in left.collect()) == [("7", "a clean t"), ("8", "one and t"), ("9", "long long"), ("None", "a clean t")]


def test_empty_table(spark, tmp_path):
    written(spark, tmp_path, [], "some item")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_hand_few_bytes_at_a_time_to_python(spark, monkeypatch):
    """By default, 10,000 rows of any length pile up in the executor and once more in its worker."""
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 1000) as text")

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    most = lambda: long.mapInArrow(size, "n long").agg({"n": "max"}).first()[0]
    for module, name in (("language", "keep_known"), ("near_dup", "keep_one"), ("decontaminate", "keep_clean"), ("pii", "with_surrogates"), ("packing", "best_fit_packing")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *_: docs)
    spark.conf.unset(BATCH_BYTES)
    assert most() > 3 * HANDED
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, long, "/root/testdata/sf0.001")
        assert spark.conf.get(BATCH_BYTES) == str(HANDED)
        assert most() < 1.1 * HANDED
        spark.conf.unset(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(1 << 20))
    corpus_pipeline.known_language(spark, long, "")
    assert spark.conf.get(BATCH_BYTES) == str(1 << 20)  # a session's own figure holds
    spark.conf.unset(BATCH_BYTES)
