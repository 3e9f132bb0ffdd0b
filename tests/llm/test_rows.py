"""Odd rows for every operator: long texts, repeated rows, null ids and texts, columns with clashing names, no rows at all."""

import pytest
from texts_for_tests import prose

from quizloom.llm import decontaminate, language_id, media, near_dedup, packing, pii, scoring, secrets, substring_dedup, token_files

OPERATORS = {
    "packing": lambda d: packing.pack_documents(d).filter("start = 0"),
    "substring_dedup": substring_dedup.remove_repeats,
    "media": lambda d: media.interleaved(media.as_pages(d), "doc_id"),
    "scoring": scoring.score_documents,
    "near_dedup": near_dedup.near_duplicates,
    "pii": pii.find_personal,
    "sanitise": pii.sanitise,
    "secrets": secrets.find_secrets,
    "redacted": secrets.redacted,
    "language_id": language_id.identify,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_each_row(docs, rows, empty, name):
    """Whatever other columns are called, and however often a row comes."""
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in rows)
    assert OPERATORS[name](empty).collect() == []


def test_stages_keep_clashing_columns(docs, rows):
    """The language stage and decontamination hand on a column called as one of their own."""
    told = language_id.predict(docs, language_id.fit(docs), ("_lang", "_score", "_ambiguous"))
    assert {r["score"] for r in told.select(*docs.columns).collect()} == {"x"}
    benchmark = docs.sparkSession.createDataFrame([(1, prose(2, 90))], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and 12 not in {r["doc_id"] for r in kept.collect()} and kept.filter("doc_id is null").count() == 1


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of over a megabyte that differ at the end, with an address, a secret and a benchmark passage in them, and a short one."""
    item = prose(900, 40)
    body = f"{prose(1, 110_000)} write to long@text.org now, token = '{'0a1b2c3d' * 5}' {item} {prose(2, 110_000)}"
    assert len(body) > 1 << 20
    rows = [(1, body, "en"), (2, body + " and an end", "en"), (3, prose(3, 40), "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1), rows, item


def test_long_texts(spark, long, tmp_path):
    docs, rows, item = long
    repeats = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert (repeats[1]["n_removed"], repeats[2]["n_words"] - repeats[2]["n_removed"], repeats[3]["n_removed"]) == (0, 3, 0)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()} == {1, 2}
    found = {r["doc_id"]: r["base"] for r in pii.find_personal(docs).collect()}
    at = rows[0][1].index("long@text.org")
    assert [(s["start"], s["end"]) for s in found[1]] == [(at, at + 13)] and found[3] == []
    assert {r["doc_id"]: r["kinds"] for r in secrets.find_secrets(docs).collect()} == {1: [0, 2], 2: [0, 2], 3: []}
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"en"}
    scores = {r["doc_id"]: r for r in scoring.score_documents(docs).collect()}
    assert scores[1]["n_tokens"] == len(rows[0][1].split()) + 1 and all(0 < r["bits_per_byte"] < 8 for r in scores.values())
    pieces = packing.pack_documents(docs).filter("doc_id = 1").agg({"length": "sum", "doc_tokens": "max"}).first()
    assert pieces["sum(length)"] == pieces["max(doc_tokens)"]
    token_files.write_tokens(docs, f"{tmp_path}/tokens")
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.digests(spark, f"{tmp_path}/tokens").collect()}[1] == pieces["max(doc_tokens)"]
    pages = {r["doc_id"]: r["items"] for r in media.interleaved(media.as_pages(docs), "doc_id").collect()}
    assert [i["kind"] for i in pages[1]] == ["media", "text"] and pages[1][1]["text"] == " ".join(rows[0][1].split())
