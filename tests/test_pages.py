"""Drawn pages, recognisers, documents, verbs and edited decks."""

import json

import pytest

from quizloom import cli, queries
from quizloom.functions import quality
from quizloom.operators import cards as C
from quizloom.operators import geometry
from quizloom.plans import capture_ir, export, page_pipeline
from quizloom.plans.text_pipeline import ALL_CAPABILITIES, text_cards
from quizloom.sources import recognise


def words(doc, lines):
    """(top, height, [(text, confidence)]) as rows of a word table."""
    for n, (top, height, own) in enumerate(lines):
        for k, (text, conf) in enumerate(own):
            yield (doc, 5, 1, 1, 1, n, k, 10 + 60 * k, top, 50, height, float(conf), text)


KIND = "doc_id long, level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
PAGE = [
    (0, 40, [("Which", 95), ("planet?", 95)]), (100, 25, [("@", 20), ("Mars", 90), ("maybe", 90)]), (130, 25, [("or", 95), ("later", 95)]), (200, 25, [("O", 30), ("Venus", 90)]), (260, 12, [("footnote", 90)]),
    (300, 40, [("Second", 95), ("question", 95)]), (340, 40, [("goes", 95), ("on", 95)]), (400, 25, [("A", 99), ("good", 95), ("answer", 95)]), (450, 25, [("~", 10), ("bad", 90)]),
]


def test_a_drawn_page(spark):
    table = spark.createDataFrame([*words(1, PAGE), *words(2, [(0, 30, [("same", 90)]), (50, 30, [("size", 90)])])], KIND)
    rows = spark.createDataFrame([(1, y, 200.0, 240.0 if 196 <= y < 230 else 200.0, 200.0, 600) for y in range(0, 600, 4)], "doc_id long, y int, red double, green double, blue double, height int")
    readings = spark.createDataFrame([(1, 200, "JD Venus itself"), (1, 100, "not marked so not read")], "doc_id long, top int, reading string")
    got = [(r["block_no"], r["question"], [(o["text"], o["marked"]) for o in r["options"]]) for r in geometry.drawn_blocks(table, rows, readings).orderBy("block_no").collect()]
    assert got == [(1, "Which planet?", [("Mars maybe or later", False), ("Venus itself", True)]), (2, "Second question goes on", [("A good answer", False), ("bad", False)])]
    texts = spark.createDataFrame([(1, "no blocks here"), (2, "1. Lettered?\nA) yes\nB) no")], "doc_id long, body string")
    blocks, _ = page_pipeline.page_blocks(table, texts, rows, readings)
    assert {(r["doc_id"], r["reading"]) for r in blocks.collect()} == {(1, "drawn"), (2, "text")}
    card = next(r for r in page_pipeline.page_cards(table, texts, rows, readings).collect() if r["doc_id"] == 1 and r["block_no"] == 1)
    assert card["tier"] == "source-verified" and card["answer_source"] == "inline-mark" and [o["text"] for o in card["options"] if o["is_correct"]] == ["Venus itself"]


def test_recognisers_and_pixels(spark):
    picture = b"P6 # c\n4 3\n255\n" + bytes([10, 20, 30] * 12)
    images = spark.createDataFrame([(1, bytearray(picture)), (2, bytearray(b"broken")), (3, None)], "doc_id long, content binary")

    def read(content):
        if not content.startswith(b"P6"):
            raise ValueError("unreadable")
        return [(1, 1, 1, 1, 1, 0, 0, 5, 9, 90.0, "Hello")]

    words = recognise.recognised(images, read).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["error"]) for r in words] == [(1, "Hello", None), (2, None, "ValueError: unreadable"), (3, None, "ValueError: unreadable")]
    edges = spark.createDataFrame([(k, 1, 9) for k in (1, 2, 3)], "doc_id long, left int, right int")
    assert [(r["y"], r["red"], r["green"], r["height"]) for r in recognise.image_rows(images, edges, 2).orderBy("y").collect()] == [(0, 10.0, 20.0, 3), (2, 10.0, 20.0, 3)]


def test_documents_hold_nulls_where_they_must(spark):
    docs = spark.createDataFrame([(1, "T", "1. A?\nA) x\nB) y\nAnswers: 1-B"), (2, "U", "nothing")], "doc_id long, title string, body string")
    cards = text_cards(docs)[1]
    got = {r["doc_id"]: json.loads(r["document"]) for r in capture_ir.capture_documents(cards, C.evidence(cards), docs, ALL_CAPABILITIES).collect()}
    card = got[1]["cards"][0]
    assert card["review"] == {"status": "needs-review", "blockingReasons": [], "reviewedBy": None, "reviewedAt": None} and card["rights"]["licenseNotes"] is None
    assert "scoring" not in card and "statement" not in card and got[1]["deck"]["bookKey"] is None and len(got[1]["evidence"]) == 3
    assert got[2]["cards"] == [] and got[2]["evidence"] == [] and got[2]["target"]["capabilities"] == sorted(ALL_CAPABILITIES)


PAGE_HTML = """<div data-question-id="a" data-family="single-choice"><p class="question-stem">Q &amp; A?</p><i class="option-item" data-correct="true">x</i><i class="option-item">y</i></div>
<div data-question-id="b" data-family="multiple-select"><p class="question-stem">All?</p><i class="option-item" data-correct="true">x</i><i class="option-item" data-correct="true">y</i></div>"""


def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page.html").write_text(PAGE_HTML)
    at = str(tmp_path / "in")
    assert cli.main(["extract", at], spark) == 0
    assert [c["family"] for c in json.loads(capsys.readouterr().out)["cards"]] == ["single-choice", "multiple-select"]
    assert cli.main(["validate", at], spark) == 1 and "capability-missing" in capsys.readouterr().out
    (tmp_path / "profile.json").write_text('{"capabilities": ["mcq.single", "mcq.multiple-select.v1"]}')
    profile = ["--profile", str(tmp_path / "profile.json")]
    assert cli.main(["validate", at, *profile], spark) == 0 and capsys.readouterr() == ("", "0 issues, 0 of them stop an export\n")
    assert cli.main(["export", at], spark) == 0 and "blocked" in capsys.readouterr().err
    assert cli.main(["export", at, *profile, "--capability", "x.y", "-o", str(tmp_path / "out")], spark) == 0 and "1 decks with 2 cards" in capsys.readouterr().err
    deck = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert deck["meta"]["cardCount"] == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "page.html").write_text("<p>nothing")
    assert cli.main(["export", str(tmp_path / "none")], spark) == 1 and cli.main([], spark) == 0


@pytest.mark.parametrize(
    ("deck", "errors"),
    [
        ("[]", ["the deck is not a JSON object"]),
        ("{", ["the deck is not a JSON object"]),
        (None, ["the deck is not a JSON object"]),
        ('{"schemaId":3,"cards":{}}', ["schemaId must be 'learncard.v1', found 3", "the deck has no cards"]),
        ('{"schemaId":"learncard.v1","cards":["x",{"type":"mcq","options":"no"}]}', ["card 1: is not an object", "card 2: the question is empty", "card 2: mcq needs an options list"]),
        ('{"schemaId":null,"cards":[{"type":7,"question":{"en":null},"cardId":0},{"type":"flashcard","question":{"en":"q"},"front":{"en":false},"back":{"en":""},"cardId":true}]}', ["schemaId must be 'learncard.v1', found None", "card 1: type 7 is not supported by this target profile", "card True: the flashcard back is empty"]),
        ('{"schemaId":"learncard.v1","cards":[{"type":"mcq","question":{"en":"q"},"cardId":null,"correctAnswer":"a","options":[{"text":"a","isCorrect":"false"},{"text":null,"isCorrect":1},{"text":"c","isCorrect":[]},{"text":" ","isCorrect":0.0},{"text":0,"isCorrect":{}}]},{"cardId":null,"type":null,"question":{"en":"q"}}]}', ["card 1: option 4 has no text", "card 1: mark exactly one correct option, 2 are marked", "card 2: type None is not supported by this target profile", "card None: duplicate cardId"]),
        ('{"schemaId":"learncard.v1","cards":[{"type":"mcq","question":{"en":"q"},"correctAnswer":null,"options":[{"text":null,"isCorrect":true},{"text":"b","isCorrect":""}]},{"question":"q"}]}', ["card 2: the question is empty", "card 2: type None is not supported by this target profile", "card : duplicate cardId"]),
        ('{"schemaId":"learncard.v1","cards":[{"type":"match","question":{"en":" "}}]}', ["card 1: the question is empty", "card 1: type 'match' is not supported by this target profile"]),
    ],
)
def test_edited_decks(spark, deck, errors):
    rows = spark.createDataFrame([(1, deck)], "doc_id long, deck string")
    assert export.check_decks(rows, []).first()["errors"] == errors


def test_alphabets_beyond_three(spark):
    rows = spark.createDataFrame([("אבx ok",), ("привет мир",), ("ไทย ok fine more",)], "t string")
    assert [r[0] for r in rows.select(quality.mixed_script_words(rows["t"])).collect()] == [["אבx"], [], []]


def test_every_alphabet_is_told(spark):
    """A letter of each, the first of equals, texts without letters, and words in two alphabets."""
    one_of_each = "aбαաאبܐހअঅਅઅଅஅఅಅഅඅกກཀက\u10d0가አᎠកᠠあアㄅ中"
    assert len(one_of_each) == len(quality.SCRIPTS)
    cases = [(c, name, []) for c, name in zip(one_of_each, quality.SCRIPTS, strict=True)]
    cases += [("אбa", "LATIN", ["אбa"]), ("аб a אבג", "HEBREW", []), ("12 !?", "", []), ("— «»", "", []), ("", "", []), (None, None, None), ("été б", "LATIN", []), ("naïve жизнъx", "LATIN", ["жизнъx"])]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = rows.select("k", quality.dominant_script(rows["t"]).alias("main"), quality.mixed_script_words(rows["t"]).alias("mixed")).orderBy("k").collect()
    assert [(r["main"], r["mixed"]) for r in got] == [c[1:] for c in cases]


def test_pixels_are_not_broadcast(spark):
    """Pixels made from a small table look as small as it is, and are many times larger."""
    edges = spark.range(3).selectExpr("id AS doc_id", "1 AS left", "CAST(3 + id AS int) AS right")
    pixels = edges.selectExpr("doc_id", "explode(sequence(0, 5)) AS x").selectExpr("*", "explode(sequence(0, 4)) AS y").selectExpr("*", "x AS red", "y AS green", "x + y AS blue")
    means = geometry.row_means(pixels, edges)
    assert "Broadcast" not in means._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["y"]): r["red"] for r in means.collect()} == {(d, y): (1 + 2 + d) / 2 for d in range(3) for y in (0, 4)}


def test_pages_of_parts_are_dealt_into_a_fixed_count_of_tasks(spark):
    """Spark put the parts together by their bytes, and read their pages in as few tasks."""
    assert "REPARTITION_BY_NUM" in queries.QUERIES["quiz_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
