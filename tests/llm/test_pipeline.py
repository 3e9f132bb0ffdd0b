"""The pipeline: stages keep the columns of documents, and what they decide takes effect."""

import random

from texts_for_tests import prose

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    item = prose(900, 40)
    rows = [(i, prose(i, 80), "en") for i in range(40)] + [(100, rows0 := prose(0, 80), "en"), (101, f"{prose(7000, 60)} {item}", "en"), (102, f"{prose(7001, 60)} token={secret}", "en"), (103, "12 34", "en"), (104, None, "en"), (105, "", None)]
    assert rows0
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, gone = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        gone.append(before - {r["doc_id"] for r in docs.select("doc_id").collect()})
        if k == 3:
            text = docs.filter("doc_id = 102").first()
            assert secret not in text["text"] and text["n_chars"] == len(text["text"])
    assert gone == [{103, 104, 105}, {100}, {101}, set(), set()]
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_rows(spark, tmp_path):
    """Null ids, equal ids with unlike texts, repeated rows and null texts: what a stage does to a row follows from its text."""
    item = prose(900, 40)
    rows = [(None, prose(10, 60)), (None, prose(11, 60)), (3, prose(12, 60)), (3, f"{prose(13, 40)} {item}"), (4, prose(14, 60)), (4, prose(14, 60)), (None, f"{prose(15, 40)} {item}"), (6, f"{prose(16, 50)} token=abcdef123456")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(100 + k, prose(100 + k, 60), "en", "s", 1) for k in range(30)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k == 3:
            left = sorted(repr((r["doc_id"], r["text"])) for r in docs.filter("doc_id is null or doc_id < 100").collect())
            clean = [rows[n] for n in (0, 1, 2, 4)] + [(6, rows[7][1].replace("token=abcdef123456", "[SECRET]"))]
            assert left == sorted(map(repr, clean))
    assert docs.filter("doc_id is null and start = 0").count() == 2


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
