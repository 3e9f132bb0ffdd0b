"""Runs with progress, lenient lines, the table function, and cards matched by what they say."""

import pytest
from pyspark.sql import functions as F

from quizloom.operators import rules
from quizloom.plans import metrics, progress
from quizloom.sources import ndjson, quiz_html


def test_one_result_or_one_error(spark):
    start, heard = spark.range(10), []

    def sink(row):
        heard.append(row["kind"])
        raise RuntimeError("nobody listens")

    rows, out = progress.run(start, [("half", lambda df: df.filter("id % 2 = 0")), ("none", lambda df: df.filter("id < 0"))], sink)
    assert [(r["kind"], r["stage"], r["rows"]) for r in rows.orderBy("seq").collect()] == [("progress", "half", None), ("progress", "half", 5), ("progress", "none", None), ("progress", "none", 0), ("result", None, 0)]
    assert out.count() == 0 and heard == ["progress"] * 4 + ["result"]
    for bad in (lambda df: df.select("gone"), lambda df: df.withColumn("x", F.raise_error(F.lit("late"))), lambda df: 1 / 0):
        rows, out = progress.run(start, [("bad", bad), ("never", lambda df: df)])
        assert out is None and [r["kind"] for r in rows.orderBy("seq").collect()] == ["progress", "error"]
    rows, out = progress.run(start, [])
    assert [(r["kind"], r["rows"]) for r in rows.collect()] == [("result", None)] and out.count() == 10


def test_lines_that_cannot_be_read_are_kept(spark):
    lines = ['{"type":"progress","index":1,"total":3,"new":{"a":1}}', '{"type":"result"', "", None, "[1]", '{"type":"error","index":"one"}', "null", '{"type":"result"}  ', "{}"]
    good, bad = ndjson.lenient(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "n int, value string"))
    assert {r["n"]: (r["type"], r["index"]) for r in good.collect()} == {0: ("progress", 1), 7: ("result", None), 8: (None, None)}
    assert {r["n"]: r["reason"] for r in bad.collect()} == {1: "not JSON", 2: "blank", 3: "blank", 4: "not an object", 5: "other types", 6: "not an object"}
    assert bad.filter("n = 1").first()["value"] == lines[1]


PAGE = """<div data-question-id="a" data-family="single-choice"><p class="question-stem">Q &amp; A?</p><i class="option-item" data-correct="true">x</i><i class="option-item">y</i></div>
<div data-question-id="b" data-family="flashcard"><i class="flashcard-front">f</i><i class="flashcard-back">b</i></div>"""


def test_table_function(spark):
    quiz_html.register(spark)
    spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>")], "id int, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT p.id, q.* FROM some_pages p, LATERAL parse_quiz_html(p.html) q ORDER BY block_no").collect()
    assert [(r["id"], r["block_no"], r["family"], r["question"], r["front"]) for r in rows] == [(1, 0, "single-choice", "Q & A?", None), (1, 1, "flashcard", None, "f")]
    assert [(o["text"], o["correct"]) for o in rows[0]["options"]] == [("x", True), ("y", False)]
    assert spark.sql("SELECT count(*) FROM some_pages p, LATERAL parse_quiz_html(p.html, 'flashcard') q").first()[0] == 1
    for wrong in ("parse_quiz_html(1)", "parse_quiz_html('x', 'no such family')"):
        with pytest.raises(Exception, match="parse_quiz_html takes|family must be"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def cards(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, block_no int, question string")


def test_cards_are_matched_by_what_they_say(spark):
    """Shifted, repeated, split and unlike cards; each is used once; the better match goes first."""
    expected = cards(spark, [(1, 1, "what is a river"), (1, 2, "same text"), (1, 3, "same text"), (1, 4, "one two three four"), (2, 1, "only here")])
    found = cards(spark, [(1, 5, "what  is a river"), (1, 6, "same text"), (1, 7, "one two"), (1, 8, "one two three"), (1, 9, "quite another thing"), (3, 1, "only here")])
    assert {tuple(r) for r in metrics.matched(expected, found).collect()} == {(1, 1, 5), (1, 2, 6), (1, 4, 8)}
    assert {r["metric"]: r["value"] for r in metrics.detection(expected, found).collect()} == {"detection_precision": 3 / 6, "detection_recall": 3 / 5}
    assert {(r["block_no"], r["question"]) for r in metrics.aligned(expected, found).collect()} == {(1, "what  is a river"), (2, "same text"), (4, "one two three")}
    none = cards(spark, [])
    assert {r["metric"]: r["value"] for r in metrics.detection(expected, none).collect()} == {"detection_precision": None, "detection_recall": 0.0}


def test_cards_are_matched_without_a_call_for_each_document(spark):
    """Equal scores go to the earlier cards, in many documents of one task; documents are not handed to Python one by one."""
    docs = range(500)
    expected = cards(spark, [(d, n, f"red green {n}") for d in docs for n in (1, 2)])
    found = cards(spark, [(d, n, f"red green {n + 5}") for d in docs for n in (3, 4, 5)])
    pairs = metrics.matched(expected, found)
    assert "InPandas" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in pairs.collect()) == [(d, n, n + 2) for d in docs for n in (1, 2)]


def test_issues_go_card_by_card(spark):
    """Evidence and equal ids of the document first, then each card's rules, then what only binds an export."""
    issue = lambda card, code, rule: (1, card, code, rule, "m")
    rows = [issue("z", "capability-missing", 8), issue("a", "unqualified-evidence", 7), issue("z", "unqualified-evidence", 7), issue("a", "option-set-mismatch", 3), issue("z", "unresolved-review", 6), issue("z", "option-set-mismatch", 3), issue("a", "duplicate-card-id", 2), issue(None, "dangling-evidence", 1)]
    issues = spark.createDataFrame(rows, "doc_id long, card_id string, code string, rule_order int, message string")
    places = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (1, "a", 3)], "doc_id long, card_id string, block_no int")
    got = [(r["card_id"], r["rule_order"]) for r in rules.in_order(issues, places).orderBy("issue_no").collect()]
    assert got == [(None, 1), ("a", 2), ("z", 3), ("z", 6), ("a", 3), ("z", 7), ("z", 8), ("a", 7)]


def test_issues_and_cards_are_dealt_out_once(spark):
    """Cards come among the issues: no join, one exchange; what has no card has no place."""
    issues = spark.createDataFrame([(1, None, "dangling-evidence", 1, "m"), (1, "a", "option-set-mismatch", 3, "m"), (None, "a", "option-set-mismatch", 3, "m")], "doc_id long, card_id string, code string, rule_order int, message string")
    places = spark.createDataFrame([(1, "a", 4), (1, "a", 2), (1, None, 1), (None, "a", 1), (2, "b", 1)], "doc_id long, card_id string, block_no int")
    found = rules.in_order(issues, places)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert {(r["doc_id"], r["card_id"], r["block_no"], r["issue_no"]) for r in found.collect()} == {(1, None, None, 1), (1, "a", 2, 2), (None, "a", None, 1)}
