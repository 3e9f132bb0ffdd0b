"""Golden texts: what is read from quiz material, and what is refused."""

import hashlib
import html
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quizloom import queries
from quizloom.functions import patterns, quality, tables, text
from quizloom.operators import cards as C
from quizloom.operators import segments
from quizloom.plans import export
from quizloom.plans.text_pipeline import ALL_CAPABILITIES, process_text, text_cards
from quizloom.sources.corpus import quizzes

BASE = """1. Which hormone lowers blood sugar?
A) Glucagon
B) Insulin
C) Cortisol
D) Adrenaline

2. Select all that apply: metals
A) Iron
B) Sulfur
C) Copper
D) Neon

3. The photon has no mass.
A) True
B) False
"""
TEXTS = {
    1: BASE + "\nAnswers:\n1. B\n2. A, C\n3. A",
    2: BASE + "\nAnswers: 1-B, 2-A C, 3-A",
    3: "1. Q one?\nA) x1\nB) y1\nAnswer: B\n2. Q two?\nA) x2\nB) y2\nAnswer: A",
    4: "1. Which?\nA) One\nB) Two",
    5: "1. Is it?\nA) Yes\nB) Maybe\nAnswers:\n1. A",
    6: "1. Metals, select all that apply\nA) Iron\nB) Sulfur\nC) Copper\nAnswers:\n1. А, С",
    7: "1. Кое?\nА) първо\nБ) второ\nВ) трето\nГ) четвърто\nОтговори:\n1. В",
    8: "Just a heading",
    9: "A) One\nB) Two",
    10: "1. What &amp; why?\nA) @ | Therei h thi Sprint 0 in 5 |\nB) No\nAnswers:\n1. A",
    11: "",
    12: None,
    13: "1. Marked?\n- yes ✓\n- no\n2. Next?\nA) a\nwrapped\nB) b (correct)",
    14: "1. One?\nA) a\nB) b\nAnswers:\n1.\nB\nprose here\n2. C",
}


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.createDataFrame([(k, f"Doc {k}", v) for k, v in TEXTS.items()], "doc_id long, title string, body string")
    return process_text(docs)


@pytest.fixture(scope="module")
def cards(result):
    rows = {}
    for r in result.cards.orderBy("doc_id", "block_no").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    return rows


def right(card):
    return [o["text"] for o in card["options"] if o["is_correct"]]


@pytest.mark.parametrize("doc", [1, 2])
def test_three_families(cards, doc):
    assert [c["family"] for c in cards[doc]] == ["single-choice", "multiple-select", "true-false"]
    assert {c["tier"] for c in cards[doc]} == {"source-verified"}
    assert [right(c) for c in cards[doc][:2]] == [["Insulin"], ["Iron", "Copper"]]
    assert cards[doc][2]["answer"] is True


def test_inline_answers_are_no_key_section(cards):
    assert [right(c) for c in cards[3]] == [["y1"], ["x2"]]
    assert {c["answer_source"] for c in cards[3]} == {"inline"}


def test_without_a_key_nothing_is_guessed(cards, result):
    assert (cards[4][0]["tier"], cards[4][0]["blocking"], right(cards[4][0])) == ("source-ambiguous", ["no-answer-key"], [])
    assert 4 not in {r["doc_id"] for r in result.decks.collect()}


def test_two_options_are_not_true_false(cards):
    assert cards[5][0]["family"] == "single-choice"


def test_letters_of_two_alphabets(cards):
    assert right(cards[6][0]) == ["Iron", "Copper"]
    assert right(cards[7][0]) == ["трето"]


def test_unsupported_blocks(result):
    assert {(r["doc_id"], r["key"], r["reject"]) for r in result.unsupported.collect()} == {(8, "block-1", "too-few-options"), (9, "block-1", "no-question-text")}


def test_an_unreadable_answer_is_not_an_answer(cards):
    card = cards[10][0]
    assert card["tier"] == "source-ambiguous" and "unreadable-answer-text" in card["blocking"]


def test_marks_and_wraps(cards):
    assert [right(c) for c in cards[13]] == [["yes"], ["b"]]
    assert [o["text"] for o in cards[13][1]["options"]] == ["a wrapped", "b"]


def test_key_rows_are_one_run(cards):
    assert right(cards[14][0]) == ["b"]


def test_empty_and_null_bodies_have_no_cards(cards):
    assert 11 not in cards and 12 not in cards


def test_decks_pass_their_own_check(result):
    assert all(not r["errors"] for r in export.check_decks(result.decks, ALL_CAPABILITIES).collect())


def test_drafts_hide_what_is_not_evidenced(result):
    rows = {(r["doc_id"], r["sequence"]): r for r in result.drafts.collect()}
    assert rows[4, "q-0001"]["status"] == "needs-answer" and '"correctAnswer":""' in rows[4, "q-0001"]["draft"]
    assert rows[1, "q-0001"]["status"] == "ready"


def test_finalize_keeps_unknown_keys(spark):
    deck = '{"status":"draft","x":1,"meta":{"review":{},"y":2},"cards":[{"review":{},"z":3}]}'
    out = export.finalize_decks(spark.createDataFrame([(1, deck), (2, None), (3, "[1]")], "doc_id long, deck string")).orderBy("doc_id").collect()
    assert [r["deck"] for r in out] == ['{"x":1,"meta":{"y":2},"cards":[{"z":3}]}', None, "[1]"]


def test_all_documents_are_normalized(spark, tmp_path):
    """Entities, accents and nulls among them, against the rules written out again."""
    from quizloom.queries import QUERIES

    texts = ["a &amp; b", "x &lt;i&gt; <b>y</b>", "e\u0301te\u0301  noir", "plain\ttext", "", None, " &nbsp; ", "\u1100\u1161 &eacute;"]
    spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "A&B")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(sf_dir):
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
            text = r["text"]
            if text is not None:
                text = unicodedata.normalize("NFC", html.unescape(re.sub("<[^>]*>", "", text)))
                text = hashlib.sha256(re.sub(r"\s+", " ", text).strip(" ").encode()).hexdigest()
            yield str((r["doc_id"], text))

    for sf_dir in (str(tmp_path), "/root/testdata/sf0.001"):
        got = QUERIES["normalize_text"](spark, sf_dir).collect()
        assert sorted(str((r["doc_id"], r["clean"])) for r in got) == sorted(brute(sf_dir))


def test_parts_are_dealt_out_before_their_quizzes_are_made(spark):
    """A small file would otherwise be one task, however much is made of it."""
    for rows in (quizzes(spark, "/root/testdata/sf0.001"), queries.QUERIES["fold_homoglyphs"](spark, "/root/testdata/sf0.001")):
        assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()


def test_letters_of_common_and_other_alphabets_count_alike(spark):
    """Fixed patterns for the first alphabets, others for texts with more: the same counts for every alphabet, in order."""
    rows = spark.createDataFrame([("abc где",), ("abгα שלום",), ("漢 aа",), ("123",), ("",)], "t string")
    got = [{quality.SCRIPTS[k]: n for k, n in enumerate(r[0]) if n} for r in rows.select(quality._letters(F.col("t"))).collect()]
    assert got == [{"LATIN": 3, "CYRILLIC": 3}, {"LATIN": 2, "CYRILLIC": 1, "GREEK": 1, "HEBREW": 4}, {"LATIN": 1, "CYRILLIC": 1, "HAN": 1}, {}, {}]
    folded = rows.select(F.size(quality._letters(F.col("t"))).alias("n"), text.collapse(F.lit(" a b\x0b\n c\x1f")).alias("c")).distinct().collect()
    assert [tuple(r) for r in folded] == [(len(quality.SCRIPTS), "a b c")]


def test_lines_are_put_in_order_once_for_all_windows(spark):
    """F5-F9, F11, F12, F16-F18, F20: stretches and blocks had windows of their own, each with a sort of every line."""
    parsed = spark.createDataFrame([(1, 0, "a", "a", "text", None, False)], "doc_id long, n int, raw string, text string, kind string, marker string, marked boolean")
    key = spark.createDataFrame([], "doc_id long, q_index int, letters array<string>, cut int")
    plan = segments.blocks(segments.placed_lines(parsed, key.hint("broadcast")))._jdf.queryExecution().sparkPlan()
    prepared = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan).toString()
    assert prepared.count("Sort [doc_id") == 1, prepared


def test_ends_and_runs_of_white_space(spark):
    """The short ways give what the patterns give, by white space of every kind at every place."""
    pieces = ["", "a", "~", "\x7f", "я", "  ", *patterns.SPACE_CHARACTERS]
    texts = sorted({a + b + c for a in (*pieces, "✓", "right: ", "<b>") for b in ("", "x", "é z") for c in (*pieces, " (wrong)", "</b>")}) + [None]
    ways = [f(F.col("t")) for f in (text.strip, text.squeezed, text.collapse, text.cleaned)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *ways).collect()
    run = f"[{re.escape(patterns.SPACE_CHARACTERS)}]"
    for t, stripped, squeezed, collapsed, cleaned in rows:
        assert cleaned == (None if t is None else text.cleaned_text(t)), repr(t)
        assert (stripped, squeezed, collapsed) == ((None,) * 3 if t is None else (t.strip(patterns.SPACE_CHARACTERS), re.sub(run + "{2,}", " ", t), re.sub(run + "+", " ", t).strip(" ")))


def test_blocks_meet_their_keys_where_they_are(spark):
    """F6, F7, F8, F17: Spark put blocks together by their bytes, into a few tasks for most of the work, and sent keys to all."""
    blocks = spark.createDataFrame([(1, 1, 1, "q", [(0, "x", "A", False)], None)], "doc_id long, block_no int, q_index int, question string, options array<struct<pos:int,text:string,marker:string,marked:boolean>>, inline_letters array<string>")
    key = spark.createDataFrame([(1, 1, ["A"], 3), (1, 2, ["B"], 3), (2, 1, ["C"], 3)], "doc_id long, q_index int, letters array<string>, cut int")
    found = C.resolved(tables.dealt(blocks, "doc_id"), tables.dealt(key, "doc_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [(r["letters"], r["answer_source"]) for r in found.collect()] == [(["A"], "answer-key")]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan, plan


def test_cards_that_are_read_once_are_not_written(spark):
    """F6, F7, F8, F17: whoever reads cards once asks for some of their columns; the others were computed and written all the same."""
    docs = spark.createDataFrame([(1, "1. Q?\nA) x\nB) y &amp; z\nAnswers: 1-B"), (2, "1. R?\nA) x\nB) y"), (3, None)], "doc_id long, body string")
    once, held = (text_cards(docs, once=o)[1] for o in (True, False))
    assert sorted(map(str, once.collect())) == sorted(map(str, held.collect())) and once.count() == 2
    assert "sha2" not in once.select("doc_id", "tier")._jdf.queryExecution().optimizedPlan().toString()


def test_answer_keys_take_one_pass(spark):
    """F6, F7, F8, F17: headings with pairs and rows below a bare one were told by two passes over all lines."""
    body = "1. Q?\nAnswers: 1-A\nAnswers:\n1. B\nAnswers: 2-C\n2. D"
    rows = segments.lines(spark.createDataFrame([(1, body), (2, "Answers:\n1. B\nAnswers: 2-C\n2. D")], "doc_id long, body string"))
    key = segments.answer_key(rows)
    assert sorted((r["doc_id"], r["q_index"], r["letters"], r["cut"]) for r in key.collect()) == [(1, 1, ["A"], 1), (2, 1, ["B"], 0)]
    assert key._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_an_edited_deck_is_made_once(spark):
    """the head and the cards of a deck each made it anew."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, '{"schemaId":"learncard.v1","cards":[]}'), (2, None)], "doc_id long, deck string").mapInArrow(make, "doc_id long, deck string")
    assert {r["doc_id"]: len(r["errors"]) for r in export.check_decks(rows, []).collect()} == {1: 1, 2: 1}
    assert made.value == 2


def test_titles_of_decks_are_not_broadcast(spark):
    """titles take few bytes on disk and are one for each document; the driver held those of all parts at once."""
    docs = spark.createDataFrame([(1, "T", "1. Q?\nA) x\nB) y\n2. R?\nA) v\nB) w\nAnswers: 1-B"), (2, "U", "nothing"), (3, "V", "1. S?\nA) x\nB) y\nAnswers: 1-A")], "doc_id long, title string, body string")
    cards = text_cards(docs)[1]
    made, drafted = export.decks(cards, docs, ALL_CAPABILITIES), export.draft_decks(cards, docs)
    for found in (made, drafted, queries.QUERIES["decks"](spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["card_count"], json.loads(r["deck"])["meta"]["title"]) for r in made.collect()} == {1: (1, {"und": "T"}), 3: (1, {"und": "V"})}
    assert {r["doc_id"]: (r["card_count"], json.loads(r["deck"])["meta"]["review"]["needsAnswer"]) for r in drafted.collect()} == {1: (2, 1), 3: (1, 0)}
