"""Queries over the driver's tables for every operator of the library, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions import identity, quality, tables, text
from quizloom.functions import patterns as P
from quizloom.functions.tables import materialized
from quizloom.operators import captures, geometry, jobs, rules, segments
from quizloom.operators import cards as C
from quizloom.plans import capture_ir, export, metrics
from quizloom.plans.text_pipeline import ALL_CAPABILITIES, text_cards
from quizloom.sources import quiz_html
from quizloom.sources.corpus import BODY, quizzes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space as the patterns of the other dialect write it.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql(pattern: str) -> str:
    """A pattern of this library for RE2, quoted for SQL."""
    out = pattern.replace(P.SPACE, _SPACE)
    for flags in ("(?diuU)", "(?diu)", "(?iu)"):
        out = out.replace(flags, "(?i)")
    return "'" + out.replace("(?d)", "").replace("'", "''") + "'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *others: str) -> DataFrame:
    """Columns of a table dealt out by its key, where much is made of small rows: one file of them would be one task."""
    return table(spark, sf_dir, name).select(key, *others).repartition(key)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- lines, keys and blocks -------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS n, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents"
_STRIPPED = f"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_MARKLESS = f"trim(regexp_replace(regexp_replace(raw, {_sql(P.CORRECT_MARK)}, ' ', 'g'), '{_SPACE}{{2,}}', ' ', 'g'))"


@query(f"""WITH l AS (SELECT doc_id, n, {_STRIPPED} AS raw FROM ({_LINES})), c AS (SELECT doc_id, n, raw, {_MARKLESS} AS clean FROM l)
SELECT doc_id, CASE WHEN raw = '' THEN 'blank' WHEN regexp_matches(clean, {_sql(P.OPTION)}) OR regexp_matches(clean, {_sql(P.BULLET)}) THEN 'option'
WHEN regexp_matches(clean, {_sql(P.NUMBERED)}) THEN 'numbered' ELSE 'text' END AS kind, count(*) AS n_lines, max(n) AS last_line FROM c GROUP BY ALL""")
def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.lines(table(spark, sf_dir, "documents"), "text")
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.col("n").cast("long")).alias("last_line"))


@query("SELECT p_partkey AS doc_id, q AS q_index, CASE q WHEN 1 THEN 'A' WHEN 2 THEN 'A,C' ELSE CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END END AS letters FROM part, (SELECT unnest([1::BIGINT, 2, 3]) AS q) WHERE p_partkey % 4 <> 0")
def answer_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = segments.answer_key(materialized(segments.lines(quizzes(spark, sf_dir)), "lines"))
    return key.select("doc_id", F.col("q_index").cast("long").alias("q_index"), F.array_join("letters", ",").alias("letters"))


@query("SELECT p_partkey AS doc_id, q AS q_index, CASE q WHEN 1 THEN 'B' ELSE 'A,C' END AS letters, 3::BIGINT AS cut FROM part, (SELECT unnest([1::BIGINT, 2]) AS q)")
def answer_key_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("1. "), "p_name", F.lit("\nA) x\nB) y\nAnswers: 1-B, 2-A C"))
    docs = dealt(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("doc_id"), body.alias("body"))
    key = segments.answer_key(materialized(segments.lines(docs), "lines"))
    return key.select("doc_id", F.col("q_index").cast("long").alias("q_index"), F.array_join("letters", ",").alias("letters"), F.col("cut").cast("long").alias("cut"))


@query("""SELECT doc_id, trim(l) AS letter, pos FROM (SELECT p_partkey AS doc_id, unnest(['A', 'C', 'D']) AS l, generate_subscripts(['A', 'C', 'D'], 1) AS pos FROM part)""")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("a, c "), F.when(F.col("p_size") % 2 == 0, "&").otherwise("+"), F.lit(" D; "), F.lit("12/"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(text.answer_letters(cell)).alias("pos", "letter"))
    return rows.select("doc_id", "letter", (F.col("pos") + 1).cast("long").alias("pos"))


_QUESTIONS = """SELECT p_partkey AS doc_id, 1::BIGINT AS q_index, concat('Which brand is part ', p_name, '?') AS question, [p_brand, 'Brand#00', 'Brand#99'] AS texts, [true, false, false] AS flags, 'single-choice' AS family FROM part
UNION ALL SELECT p_partkey, 2, 'Select all that apply to it', [concat('Size ', p_size), 'Size 0', concat('Type ', p_type)], [true, false, true], 'multiple-select' FROM part
UNION ALL SELECT p_partkey, 3, 'Its size is even', ['True', 'False'], [p_size % 2 = 0, p_size % 2 <> 0], 'true-false' FROM part"""


@query(f"SELECT doc_id, q_index AS block_no, q_index, question, array_to_string(texts, '|') AS options FROM ({_QUESTIONS})")
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = materialized(segments.lines(quizzes(spark, sf_dir)), "lines")
    rows = segments.blocks(segments.placed_lines(parsed, segments.answer_key(parsed)))
    return _long(rows.select("doc_id", "block_no", "q_index", "question", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options")), "block_no", "q_index")


@query("SELECT p_partkey AS doc_id, b AS block_no, CASE b WHEN 1 THEN concat('Stem of ', p_name) ELSE concat('Second of ', p_name, ' goes on') END AS question, CASE b WHEN 1 THEN 'one wraps on|two' ELSE 'three|four' END AS options FROM part, (SELECT unnest([1::BIGINT, 2]) AS b)")
def segment_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without numbers: options that start over open one, text after an option continues it."""
    body = F.concat(F.lit("Stem of "), "p_name", F.lit("\nA) one\nwraps on\nB) two\n\nSecond of "), "p_name", F.lit(" goes on\nA) three\nB) four"))
    parsed = materialized(segments.lines(dealt(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("doc_id"), body.alias("body"))), "lines")
    rows = segments.blocks(segments.placed_lines(parsed, segments.answer_key(parsed)))
    return _long(rows.select("doc_id", "block_no", "question", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options")), "block_no")


# ---- cards, export, drafts --------------------------------------------------------------------------------------------


def _cards(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Cards of the quizzes; once: for what reads them a single time."""
    return text_cards(quizzes(spark, sf_dir, spread=False), once=once)[1]


_KNOWN = "doc_id % 4 <> 0"


@query(f"""SELECT doc_id, q_index, family, CASE WHEN {_KNOWN} THEN 'source-verified' ELSE 'source-ambiguous' END AS tier, CASE WHEN {_KNOWN} THEN len(list_filter(flags, lambda f: f)) ELSE 0 END::BIGINT AS n_correct,
CASE WHEN {_KNOWN} THEN '' ELSE 'no-answer-key' END AS blocking, CASE WHEN {_KNOWN} THEN 'answer-key' ELSE 'none' END AS answer_source FROM ({_QUESTIONS})""")
def card_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_cards(spark, sf_dir).select("doc_id", "q_index", "family", "tier", "n_correct", F.array_join("blocking", ",").alias("blocking"), "answer_source"), "q_index", "n_correct")


_FP = "sha256(concat('qfp:1', chr(10), 'origin:file://local', chr(10), 'path:/upload', chr(10), 'family:', family, chr(10), 'question:', question, chr(10), 'option_count:', len(texts), chr(10), 'options:', array_to_string(list_sort(texts), chr(10))))"
_SRC = f"concat('src_', substr(sha256(concat('sid:1', chr(10), 'origin:file://local', chr(10), 'path:/upload', chr(10), 'qfp:', {_FP})), 1, 32))"


@query(f"""WITH s AS (SELECT *, {_SRC} AS source_id FROM ({_QUESTIONS}))
SELECT doc_id, q_index, source_id, concat('q-', substr(sha256(concat('crd:1', chr(10), 'source_id:', source_id)), 1, 16)) AS card_id, concat('draft_', substr(source_id, 1, 24), '_', family) AS draft_id,
concat('opt_', substr(sha256(concat('oid:1', chr(10), 'source_id:', source_id, chr(10), 'clean_text:', texts[1])), 1, 32)) AS first_option FROM s""")
def source_option_card_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_cards(spark, sf_dir).select("doc_id", "q_index", "source_id", "card_id", "draft_id", F.get("options", F.lit(0))["option_id"].alias("first_option")), "q_index")


@query(f"SELECT doc_id, concat('q-000', q_index) AS sequence, family, array_to_string(list_transform(list_filter(list_zip(texts, flags), lambda x: x[2]), lambda x: x[1]), '|') AS correct FROM ({_QUESTIONS}) WHERE {_KNOWN}")
def export_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.gated(_cards(spark, sf_dir), ALL_CAPABILITIES).filter("reason is null")
    return rows.select("doc_id", "sequence", "family", F.array_join(F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["text"]), "|").alias("correct"))


_UNVERIFIED = "answerEvidenceTier ''source-ambiguous'' is not exportable; needs one of [''reviewer-confirmed'', ''source-verified'']"


@query(f"""SELECT doc_id, family, CASE WHEN NOT {_KNOWN} THEN '{_UNVERIFIED}' WHEN family = 'multiple-select' THEN 'target does not declare mcq.multiple-select.v1' ELSE 'target does not declare mcq.true-false' END AS reason
FROM ({_QUESTIONS}) WHERE NOT {_KNOWN} OR family <> 'single-choice'""")
def export_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.blocked(_cards(spark, sf_dir), ["mcq.single"]).select("doc_id", "family", "reason")


_SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_KEY = f"concat(regexp_replace(substr(CASE WHEN {_SLUG} = '' THEN 'captured' ELSE {_SLUG} END, 1, 40), '-+$', ''), '-', substr(sha256(p_name), 1, 8))"


@query(f"SELECT p_partkey AS doc_id, {_KEY} AS deck_key FROM part")
def deck_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.deck_key(F.col("p_name")).alias("deck_key"))


@query(f"SELECT p_partkey AS doc_id, {_KEY} AS deck_key, 3::BIGINT AS card_count, 'learncard.v1' AS schema_id, p_brand AS first_answer FROM part WHERE p_partkey % 4 <> 0")
def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = export.decks(_cards(spark, sf_dir), quizzes(spark, sf_dir, spread=False), ALL_CAPABILITIES)
    return found.select("doc_id", "deck_key", "card_count", F.get_json_object("deck", "$.schemaId").alias("schema_id"), F.get_json_object("deck", "$.cards[0].correctAnswer").alias("first_answer"))


@query("SELECT p_partkey AS doc_id, 0::BIGINT AS n_errors FROM part WHERE p_partkey % 4 <> 0")
def deck_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = export.decks(_cards(spark, sf_dir), quizzes(spark, sf_dir, spread=False), ALL_CAPABILITIES)
    return export.check_decks(export.finalize_decks(found), ALL_CAPABILITIES).select("doc_id", F.size("errors").cast("long").alias("n_errors"))


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'card a: mark exactly one correct option, 2 are marked' WHEN 1 THEN 'card a: correctAnswer must repeat the text of the correct option' ELSE 'the deck has no cards' END AS errors FROM part""")
def deck_check_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def deck(second: str, answer: str) -> F.Column:
        return F.lit('{"schemaId":"learncard.v1","cards":[{"cardId":"a","type":"mcq","question":{"en":"q"},"correctAnswer":"%s","options":[{"text":"x","isCorrect":true},{"text":"y","isCorrect":%s}]}]}' % (answer, second))

    body = F.when(F.col("p_partkey") % 3 == 0, deck("true", "x")).when(F.col("p_partkey") % 3 == 1, deck("false", "y")).otherwise('{"schemaId":"learncard.v1","cards":[]}')
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("deck"))
    return export.check_decks(rows, []).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT doc_id, concat('q-000', q_index) AS sequence, family, CASE WHEN {_KNOWN} THEN 'ready' ELSE 'needs-answer' END AS status FROM ({_QUESTIONS})")
def draft_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.drafts(_cards(spark, sf_dir)).select("doc_id", "sequence", "family", "status")


@query("SELECT p_partkey AS doc_id, 3::BIGINT AS cards, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS needs_answer, 0::BIGINT AS needs_review, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3 END::BIGINT AS ready FROM part")
def draft_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.draft_summary(export.drafts(_cards(spark, sf_dir)))


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(['unresolved-review', 'unresolved-review', 'unresolved-review', 'unqualified-evidence', 'unqualified-evidence', 'unqualified-evidence', 'single-choice-cardinality', 'multiple-select-empty']) AS code FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'capability-missing' FROM part) GROUP BY code""")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir, once=False)
    return rules.validate(cards, C.evidence(cards), ["mcq.single"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, count(*) + sum(len(texts))::BIGINT AS n, CASE WHEN {_KNOWN} THEN 4 ELSE 0 END::BIGINT AS n_solution FROM ({_QUESTIONS}) GROUP BY doc_id")
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evidence(_cards(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authority") == "solution").alias("n_solution"))


@query("SELECT p_partkey AS doc_id, 'block-1' AS key, CASE WHEN p_partkey % 2 = 0 THEN 'too-few-options' ELSE 'no-question-text' END AS reject FROM part")
def unsupported_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("About "), "p_name")).otherwise(F.lit("A) One\nB) Two"))
    docs = dealt(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("doc_id"), body.alias("body"))
    return C.unsupported(text_cards(docs, once=True)[1])


# ---- rules over other tables ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS doc_id, l_suppkey::VARCHAR AS card_id, 'option ' || (l_partkey % 5) || ' appears ' || count(*) || ' times' AS message FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey % 5 HAVING count(*) > 1")
def issues_duplicate_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("card_id"), (F.col("l_partkey") % 5).cast("string").alias("option_id"))
    return rules.duplicate_options(rows).select("doc_id", "card_id", "message")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS card_id, 'card appears ' || count(*) || ' times' AS message FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def issues_duplicate_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("card_id"))
    return rules.duplicate_cards(rows).select("doc_id", "card_id", "message")


@query("""SELECT doc_id, 'not in the ledger: ' || string_agg(id, ', ' ORDER BY id) AS message FROM (SELECT DISTINCT l_orderkey % 50 AS doc_id, 'ev_' || l_partkey AS id FROM lineitem) r
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE 'ev_' || p.p_partkey = r.id AND p.p_size % 2 = 0) GROUP BY doc_id""")
def issues_dangling_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), F.concat(F.lit("ev_"), F.col("l_partkey").cast("string")).alias("evidence_id"))
    held = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("ev_"), F.col("p_partkey").cast("string")).alias("evidence_id"))
    ledger = rows.join(held, "evidence_id", "left_semi")
    return rules.dangling_evidence(rows, ledger).select("doc_id", "message")


@query("SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 1")
def issues_option_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = lambda i, right: F.struct(F.lit(i).alias("option_id"), right.alias("is_correct"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("c").alias("card_id"), F.array(option("a", F.lit(True)), option("b", F.col("p_partkey") % 3 == 1)).alias("options"), F.array(F.lit("a")).alias("correct_option_ids"))
    return rules.option_set_mismatch(rows).select("doc_id")


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'single-choice-cardinality' WHEN 1 THEN 'multiple-select-empty' WHEN 2 THEN 'true-false-labels' WHEN 3 THEN 'typed-no-answer' ELSE 'flashcard-incomplete' END AS code FROM part")
def issues_family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("single-choice", "multiple-select", "true-false", "typed", "flashcard")])
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit("c").alias("card_id"), F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("family"), F.array().cast("array<string>").alias("correct_option_ids"),
        F.lit("yes").alias("true_label"), none.alias("false_label"), F.lit("f").alias("front"), none.alias("back"), F.array().cast("array<string>").alias("acceptable"),
    )
    return rules.family_rules(rows).select("doc_id", "code")


@query("SELECT o_orderkey AS doc_id, o_custkey AS left_item_id, o_orderkey % 40 AS right_item_id FROM orders WHERE o_custkey % 7 = 0 OR o_orderkey % 40 >= 25")
def issues_matching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("c").alias("card_id"), F.col("o_custkey").alias("left_item_id"), (F.col("o_orderkey") % 40).alias("right_item_id"))
    left = pairs.filter("left_item_id % 7 <> 0").select("doc_id", "card_id", F.lit("left").alias("side"), F.col("left_item_id").alias("item_id"))
    right = pairs.filter("right_item_id < 25").select("doc_id", "card_id", F.lit("right").alias("side"), F.col("right_item_id").alias("item_id"))
    found = rules.matching_pairs(pairs, left.unionByName(right))
    return found.select("doc_id", F.split("message", " - ")[0].cast("long").alias("left_item_id"), F.split("message", " - ")[1].cast("long").alias("right_item_id"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'missing-evidence-tier' ELSE 'unqualified-evidence' END AS code FROM orders WHERE o_orderkey % 3 < 2")
def issues_evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_orderkey") % 3 == 1, "ocr-only").when(F.col("o_orderkey") % 3 == 2, "reviewer-confirmed")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("c").alias("card_id"), tier.alias("tier"))
    return rules.evidence_tier(rows).select("doc_id", "code")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 2 = 0")
def issues_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("c").alias("card_id"), F.when(F.col("o_orderkey") % 2 == 0, "multiple-select").otherwise("single-choice").alias("family"))
    return rules.capability_missing(rows, ["mcq.single"]).select("doc_id")


_MODES = ("flashcard", "mcq", "mcq", "mcq", "mcq", "typed", "odd")
_MODE_NAMES = ("flashcard", "mcq-single", "mcq-multiple", "mcq-true-false", "unknown", "typed", "unknown")
_MARKERS = ("", "", ',"selectionMode":"multiple"', ',"sourceFormat":"true-false"', ',"selectionMode":"multiple","sourceFormat":"true-false"', "", "")


def _mode_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = F.array(*[F.lit('{"type":"%s"%s,"correctAnswer":' % x) for x in zip(_MODES, _MARKERS, strict=True)])
    answer = F.when(F.col("p_size") % 3 == 0, '" "').when(F.col("p_size") % 3 == 1, '"yes"').otherwise("7")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.get(cards, (F.col("p_partkey") % 7).cast("int")), answer, F.lit("}")).alias("card"))


_MODE_SQL = "[" + ", ".join(f"'{m}'" for m in _MODE_NAMES) + "][p_partkey % 7 + 1]"


@query(f"SELECT p_partkey AS doc_id, {_MODE_SQL} AS mode FROM part")
def detect_card_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode_cards(spark, sf_dir).select("doc_id", rules.card_mode(F.col("card")).alias("mode"))


@query(f"SELECT p_partkey AS doc_id, {_MODE_SQL} IN ('mcq-single', 'mcq-true-false') AND p_size % 3 = 1 AS safe FROM part")
def typed_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode_cards(spark, sf_dir).select("doc_id", rules.typed_promotion_safe(F.col("card")).alias("safe"))


# ---- text functions ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '{_SPACE}+', ' ', 'g'))) AS clean FROM documents")
def collapse_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out and white space collapsed, over every document: the part of normalize_text that SQL can express."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse(text.strip_markup(F.col("text"))), 256).alias("clean"))


@query()
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: those with entities or accents to compose as well, which SQL cannot express, and null texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(text.needs_python(F.col("text")), F.lit(False)).alias("python"))
    parts = [rows.filter(F.col("python") == python).select("doc_id", F.sha2(text.normalized(F.col("text"), python), 256).alias("clean")) for python in (False, True)]
    return parts[0].unionAll(parts[1])


@query(rf"""SELECT doc_id, CASE WHEN contains(text, '&') OR regexp_matches(text, '[\x{{300}}-\x{{3ff}}\x{{460}}-\x{{200f}}\x{{2028}}-\x{{10ffff}}]') THEN 'entities or accents'
ELSE sha256(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '{_SPACE}+', ' ', 'g'))) END AS clean FROM documents""")
def normalize_in_jvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each document goes, and what the way in the JVM makes of it: the part of normalize_text that SQL can follow."""
    told = F.coalesce(text.needs_python(F.col("text")), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(told, "entities or accents").otherwise(F.sha2(text.normalized(F.col("text")), 256)).alias("clean"))


@query("SELECT p_partkey AS doc_id, p_name AS clean FROM part")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, words and notes of feedback around each name, in turn; markup and white space as well."""
    marks = F.array(*[F.lit(x) for x in ("✓ ", "correct: ", "● Right. ", " <b>")])
    notes = F.array(*[F.lit(x) for x in (" (correct)", "", "</b>\t (Right Answer) ", " ")])
    dirty = F.concat(F.get(marks, (F.col("p_partkey") % 4).cast("int")), "p_name", F.get(notes, (F.col("p_size") % 4).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.cleaned(dirty).alias("clean"))


_RATIO = f"length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '{_SPACE}', '', 'g'))"


@query(f"SELECT conv_id, turn, CASE WHEN length(regexp_replace(text, '{_SPACE}', '', 'g')) = 0 THEN 0 ELSE round({_RATIO}, 9) END AS ratio, coalesce(regexp_matches(text, '[|@¤§¶©®™\\\\^~`]'), false) AS has_furniture FROM conversations")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.round(quality.letter_ratio(F.col("text")), 9).alias("ratio"), (F.size(quality.furniture(F.col("text"))) > 0).alias("has_furniture"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'written in two alphabets at once: mаss' WHEN 1 THEN 'a few words in another alphabet than the rest: тест' ELSE '' END AS reasons FROM part")
def script_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, "the mаss of it").when(F.col("p_partkey") % 3 == 1, "a long тест of many plain words here").otherwise("a plain line of words")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(quality.reasons(line), "; ").alias("reasons"))


@query("SELECT p_partkey AS doc_id, concat('the whole text of part ', p_name) AS folded FROM part")
def fold_homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word of each line has lookalike letters of the other alphabet; folding gives the line back."""
    line = F.concat(F.lit("the whоle tехt of part "), "p_name")
    return dealt(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("doc_id"), quality.fold_homoglyphs(line).alias("folded"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'А,В,С' ELSE 'A,B,C' END AS letters FROM part")
def fold_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("А"), F.lit("Б"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    letters = F.array(F.lit("A"), F.lit("В"), F.lit("C"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(text.fold_letters(letters, markers), ",").alias("letters"))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN 'multiple-select' WHEN p_partkey % 4 = 1 THEN 'true-false' WHEN p_partkey % 4 = 2 THEN 'multiple-select' ELSE 'single-choice' END AS family FROM part""")
def family_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    options = F.when(k == 1, F.array(F.lit("Falsch."), F.lit("wahr"))).otherwise(F.array(F.lit("Yes"), F.lit("Maybe")))
    question = F.when(k == 0, F.concat("p_name", F.lit(": wähle alle"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.family(question, options, F.when(k == 2, 2).otherwise(1)).alias("family"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN concat('To ', p_name) ELSE 'None of it' END AS kept FROM part")
def leading_widget(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit("@X "), "p_name")).when(k == 1, F.concat(F.lit("6. "), "p_name")).when(k == 2, F.concat(F.lit("To "), "p_name")).otherwise(F.lit("JD None of it"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), quality.drop_leading_widget(line).alias("kept"))


# ---- pages with boxes -------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(5).alias("level"), F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.floor((n + 1) / 2).cast("int").alias("line_num"), n.alias("word_num"),
        (n * 100).cast("int").alias("left"), F.floor((n + 1) / 2).cast("int").alias("top"), F.lit(90).alias("width"), (F.col("l_quantity") + 10).cast("int").alias("height"), (F.col("l_quantity") * 2).cast("double").alias("conf"), F.col("l_returnflag").alias("text"),
    )


_WORDS = "SELECT l_orderkey AS doc_id, (l_linenumber + 1) // 2 AS line_num, l_linenumber AS word_num, l_linenumber * 100 AS lft, (l_quantity::INT + 10) AS height, l_quantity::DOUBLE * 2 AS conf, l_returnflag AS text FROM lineitem WHERE l_quantity * 2 >= 30"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS line_no, string_agg(text, ' ' ORDER BY lft, text) AS text, min(lft)::BIGINT AS lft, max(lft + 90)::BIGINT AS rgt, quantile_cont(height, 0.5)::DOUBLE AS size, round(avg(conf), 6) AS confidence FROM ({_WORDS}) GROUP BY doc_id, line_num")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.text_lines(_words(spark, sf_dir))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.col("left").cast("long").alias("lft"), F.col("right").cast("long").alias("rgt"), F.col("size").cast("double").alias("size"), F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id, CASE WHEN n49 = 0 THEN 29.0 ELSE 49.0 END::DOUBLE AS question_size, CASE WHEN n29 = 0 THEN 49.0 ELSE 29.0 END::DOUBLE AS choice_size FROM (SELECT l_orderkey AS doc_id, count(*) FILTER (l_linenumber % 3 = 1) AS n49, count(*) FILTER (l_linenumber % 3 <> 1) AS n29 FROM lineitem GROUP BY 1)")
def role_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_linenumber") % 3 == 1, 49.0).otherwise(29.0)
    return geometry.role_sizes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), size.alias("size")))


_ROWS = "SELECT l_orderkey AS doc_id, l_linenumber * 20 AS y, CASE WHEN max(l_quantity) > 25 THEN (CASE WHEN max(l_returnflag) = 'R' THEN 0 ELSE 1 END) ELSE -1 END AS lean FROM lineitem GROUP BY ALL"


@query(f"""WITH r AS ({_ROWS}), o AS (SELECT *, CASE WHEN lag(lean, 1, -2) OVER w <> lean THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY y)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY y) AS run FROM o), s AS (SELECT doc_id, run, min(y) AS top, min(lean) AS channel FROM g GROUP BY doc_id, run),
b AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY doc_id ORDER BY run), 200) AS bottom FROM s)
SELECT doc_id, top::BIGINT AS top, bottom::BIGINT AS bottom, channel::BIGINT AS channel FROM b WHERE channel >= 0 AND bottom - top >= 12""")
def band_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_bands(spark, sf_dir), "top", "bottom", "channel")


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tinted, red = F.col("q") > 25, F.col("f") == "R"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    rows = rows.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 20).cast("int").alias("y"), F.when(tinted & red, 240.0).otherwise(200.0).alias("red"),
        F.when(tinted & ~red, 240.0).otherwise(200.0).alias("green"), F.lit(200.0).alias("blue"), F.lit(200).alias("height"),
    )
    return geometry.emphasis_bands(rows)


@query(f"""WITH b AS ({SQL["band_runs"]}), l AS (SELECT l_orderkey AS doc_id, l_linenumber * 20 + 5 AS centre FROM lineitem WHERE l_linenumber % 2 = 0),
m AS (SELECT * FROM b WHERE EXISTS (SELECT 1 FROM l WHERE l.doc_id = b.doc_id AND l.centre BETWEEN b.top AND b.bottom)),
c AS (SELECT doc_id, channel, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT doc_id, channel FROM c QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1),
u AS (SELECT doc_id, min(channel) AS channel FROM k GROUP BY doc_id HAVING count(*) = 1)
SELECT m.doc_id, m.top, m.bottom, m.channel FROM m JOIN u USING (doc_id, channel)""")
def marking_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "lineitem").filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 20).alias("top"), (F.col("l_linenumber") * 20 + 10).alias("bottom"))
    return _long(geometry.marking_bands(_bands(spark, sf_dir), options).select("doc_id", "top", "bottom", "channel"), "top", "bottom", "channel")


@query("SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS option_no, (l_returnflag = 'R' AND 2 * count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) <= count(*) OVER (PARTITION BY l_orderkey)) AS marked FROM lineitem")
def settle_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("option_no"), (F.col("l_returnflag") == "R").alias("marked"))
    return geometry.settled(rows, ["doc_id"])


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 > o_custkey % 5 THEN 'drawn' ELSE 'text' END AS reading, greatest(o_orderkey % 5, o_custkey % 5)::BIGINT AS usable FROM orders")
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit("text").alias("reading"), (F.col("o_custkey") % 5).cast("long").alias("usable")), F.struct(F.lit("drawn").alias("reading"), (F.col("o_orderkey") % 5).cast("long").alias("usable")))).alias("r"))
    return geometry.choose_reading(rows.select("doc_id", "r.*"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END::BIGINT AS psm FROM orders")
def recognition_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda attempt, psm, words, ok: F.struct(F.lit(attempt).alias("attempt"), F.lit(psm).alias("psm"), F.lit(words).alias("text"), ok.alias("accepted"))
    no, some = F.lit(False), F.col("o_orderkey") % 3 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(one(0, 3, "a b c", no), one(1, 4, "a", some), one(2, 6, "x y z", no))).alias("p"))
    return _long(geometry.best_pass(rows.select("doc_id", "p.*")).select("doc_id", "psm"), "psm")


# ---- captures ---------------------------------------------------------------------------------------------------------


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 3 == 0, "reveal").when(F.col("event_id") % 17 == 1, "unknown").otherwise("question")
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("capture_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.col("user_id").cast("string").alias("question_fingerprint"),
        F.concat_ws(":", F.col("user_id").cast("string"), state).alias("state_fingerprint"), state.alias("state"), F.when(state == "reveal", F.col("event_type")).alias("answer_key"),
    )


_CAPTURES = """SELECT lpad(event_id::VARCHAR, 12, '0') AS capture_id, ts, user_id::VARCHAR AS q, event_type AS answer_key, CASE WHEN event_id % 3 = 0 THEN 'reveal' WHEN event_id % 17 = 1 THEN 'unknown' ELSE 'question' END AS state FROM events"""


@query(f"SELECT q || ':' || state AS state_fingerprint, arg_min(capture_id, (ts, capture_id)) AS capture_id FROM ({_CAPTURES}) GROUP BY q, state")
def capture_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.deduplicated(_captures(spark, sf_dir)).select("state_fingerprint", "capture_id")


@query(f"""SELECT q AS question_fingerprint, question_id, reveal_id, n_keys, CASE WHEN n_keys > 1 OR (unknown AND reveal_id IS NULL) THEN 'NeedsReview' WHEN reveal_id IS NULL THEN 'AwaitingEvidence' WHEN question_id IS NULL THEN 'RevealCaptured' ELSE 'DraftReady' END AS status
FROM (SELECT q, arg_min(capture_id, (ts, capture_id)) FILTER (state = 'question') AS question_id, arg_min(capture_id, (ts, capture_id)) FILTER (state = 'reveal') AS reveal_id, count(DISTINCT answer_key) FILTER (state = 'reveal') AS n_keys, bool_or(state = 'unknown') AS unknown FROM ({_CAPTURES}) GROUP BY q)""")
def capture_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.paired(_captures(spark, sf_dir))


@query(f"SELECT q AS question_fingerprint, count(DISTINCT answer_key) AS n_keys FROM ({_CAPTURES}) WHERE state = 'reveal' GROUP BY q HAVING count(DISTINCT answer_key) > 1")
def capture_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.contradictions(_captures(spark, sf_dir))


@query("""SELECT l_orderkey AS doc_id, sha256(concat('sfp:1', chr(10), 'qfp:', l_orderkey, chr(10), 'options:', string_agg(concat(l_partkey, ':', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, ':', l_linestatus), '|' ORDER BY l_partkey::VARCHAR, l_linenumber, l_returnflag = 'R', l_linestatus), chr(10), 'explanation:')) AS state_fingerprint FROM lineitem GROUP BY l_orderkey""")
def state_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("clean"), (F.col("l_returnflag") == "R").alias("checked"), F.col("l_linestatus").alias("visible"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(state)).alias("states"))
    return rows.select("doc_id", identity.state_fingerprint(F.col("doc_id").cast("string"), F.col("states"), F.array().cast("array<string>")).alias("state_fingerprint"))


@query("SELECT o_orderkey AS doc_id, concat('cap_', sha256(concat('cid:1', chr(10), 'created:', o_orderstatus, chr(10), 'origin:file://local', chr(10), 'path:/upload', chr(10), 'state:reveal', chr(10), 'qfp:', repeat('0', 64), chr(10), 'artifacts:', array_to_string(list_sort([o_custkey::VARCHAR, o_orderkey::VARCHAR]), chr(10))))) AS capture_id FROM orders")
def capture_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    found = identity.capture_id(F.col("o_orderstatus"), F.lit("file://local"), F.lit("/upload"), F.lit("reveal"), F.lit("0" * 64), artifacts)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), found.alias("capture_id"))


# ---- pages ------------------------------------------------------------------------------------------------------------


def _quiz_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a page for each part: a question with an entity and tags, true/false, a flashcard, and a family that is none."""
    even = F.col("p_size") % 2 == 0
    html = F.concat(
        F.lit('<main><div data-question-id="a" data-family="single-choice"><p class="big question-stem">Brand &amp; type<br>of <b>'), "p_name", F.lit('</b></p><ul><li class="option-item" data-correct="true"><span data-clean-text="'), "p_brand",
        F.lit('">✓ x</span><li class="option-item">Other</ul></div></i><div data-question-id="b" data-family="true-false"><p class="question-stem">Even size</p><span class="option-item" data-correct="'), even.cast("string"), F.lit('">True</span><span class="option-item" data-correct="'), (~even).cast("string"),
        F.lit('">False</span></div><div data-question-id="c" data-family="flashcard"><i class="flashcard-front">'), "p_name", F.lit('</i><i class="flashcard-back">'), "p_brand", F.lit('</i></div><div data-question-id="d" data-family="image-occlusion"></div></main>'),
    )
    parts = tables.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return quiz_html.cards(parts.select(F.col("p_partkey").alias("doc_id"), html.alias("html")))


@query("""SELECT p_partkey AS doc_id, k AS block_no, CASE k WHEN 0 THEN 'single-choice' WHEN 1 THEN 'true-false' WHEN 2 THEN 'flashcard' ELSE 'image-occlusion' END AS family, CASE k WHEN 0 THEN concat('Brand & type of ', p_name) WHEN 1 THEN 'Even size' WHEN 2 THEN p_name END AS question,
CASE k WHEN 0 THEN p_brand WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END ELSE '' END AS correct, CASE WHEN k = 3 THEN 'family' END AS reject FROM part, (SELECT unnest([0::BIGINT, 1, 2, 3]) AS k)""")
def quiz_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quiz_cards(spark, sf_dir)
    correct = F.array_join(F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["text"]), "|")
    return rows.select("doc_id", F.col("block_no").cast("long").alias("block_no"), "family", "question", F.coalesce(correct, F.lit("")).alias("correct"), "reject")


@query(f"SELECT p_partkey AS doc_id, {_KEY} AS deck_key, 3::BIGINT AS card_count, p_brand AS first_answer, CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END AS second_answer, 'flashcard' AS third_type, p_brand AS third_back FROM part")
def page_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiz pages all the way to a deck, a flashcard among its cards."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    found = export.decks(materialized(_quiz_cards(spark, sf_dir), "cards"), docs, ALL_CAPABILITIES)
    get = lambda path: F.get_json_object("deck", f"$.cards{path}")
    return found.select("doc_id", "deck_key", "card_count", get("[0].correctAnswer").alias("first_answer"), get("[1].correctAnswer").alias("second_answer"), get("[2].type").alias("third_type"), get("[2].back.en").alias("third_back"))


_PAGE_FP = "sha256(concat('qfp:1', chr(10), 'origin:https://fixture.local', chr(10), 'path:/fixture.html', chr(10), 'family:single-choice', chr(10), 'question:Brand & type of ', p_name, chr(10), 'option_count:2', chr(10), 'options:', array_to_string(list_sort([p_brand, 'Other']), chr(10))))"
_PAGE_SRC = f"concat('src_', substr(sha256(concat('sid:1', chr(10), 'origin:https://fixture.local', chr(10), 'path:/fixture.html', chr(10), 'qfp:', {_PAGE_FP})), 1, 32))"


@query(f"SELECT p_partkey AS doc_id, concat('draft_', substr(sha256(concat('drf:1', chr(10), 'source_id:', {_PAGE_SRC}, chr(10), 'family:single-choice')), 1, 16)) AS draft_id FROM part")
def page_draft_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quiz_cards(spark, sf_dir).filter("block_no = 0").select("doc_id", "draft_id")


_CYRILLIC = "translate(p_type, 'AEO', 'АЕО')"


@query(f"""WITH t AS (SELECT p_partkey AS doc_id, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN {_CYRILLIC} WHEN 1 THEN p_type ELSE p_name || ' and more words' END AS b FROM part),
r AS (SELECT *, length(regexp_replace(b, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace(b, '[^\\p{{L}}]', '', 'g')) AS rb, len(string_split(a, ' ')) AS na, len(string_split(b, ' ')) AS nb FROM t)
SELECT doc_id, round(rb, 9) AS current_ratio, (1 > rb + 0.05) OR (na > nb) AS better FROM r""")
def reads_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a row beside others: with letters of another alphabet, other text, and more words."""
    k = F.col("p_partkey") % 3
    current = F.when(k == 0, F.translate("p_type", "AEO", "АЕО")).when(k == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" and more words")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("a"), current.alias("b"))
    return rows.select("doc_id", F.round(quality.latin_ratio(F.col("b")), 9).alias("current_ratio"), quality.reads_better(F.col("a"), F.col("b")).alias("better"))


@query(f"SELECT p_partkey AS doc_id, sha256({BODY.replace('AS string', 'AS VARCHAR')}) AS body FROM part")
def quiz_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quizzes(spark, sf_dir).select("doc_id", F.sha2("body", 256).alias("body"))


# ---- whole pages, documents, drafts and jobs ---------------------------------------------------------------------------


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page for each order: every third line is a question in large type, the others open with a widget that is read badly
    where the quantity is small; returned lines are tinted."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n"))
    lines = lines.agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("double").alias("q"), F.max("l_returnflag").alias("f"))
    height = F.when(F.col("n") % 3 == 1, 49).otherwise(29)
    word = lambda k, left, conf, text: F.struct(F.lit(k).alias("word_num"), F.lit(left).alias("left"), conf.alias("conf"), text.alias("text"))
    two = F.array(word(1, 10, F.col("q") * 2, F.lit("X")), word(2, 60, F.lit(95.0), F.concat(F.lit("item"), F.col("p").cast("string"))))
    words = lines.select("doc_id", "n", height.alias("height"), F.explode(two).alias("w"))
    one = F.lit(1)
    words = words.select("doc_id", F.lit(5).alias("level"), one.alias("page_num"), one.alias("block_num"), one.alias("par_num"), F.col("n").alias("line_num"), "w.word_num", "w.left", (F.col("n") * 100 + 30).alias("top"), F.lit(40).alias("width"), "height", "w.conf", "w.text")
    tint = F.when(F.col("f") == "R", 240.0).otherwise(200.0)
    rows = lines.select("doc_id", F.explode(F.sequence(F.col("n") * 100, F.col("n") * 100 + 80, F.lit(20))).alias("y"), F.lit(200.0).alias("red"), tint.alias("green"), F.lit(200.0).alias("blue"), F.lit(1000).alias("height"))
    return words, rows


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_partkey) AS p, max(l_quantity)::DOUBLE AS q, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
k AS (SELECT *, n % 3 = 1 AS stem FROM l WHERE doc_id IN (SELECT doc_id FROM l GROUP BY doc_id HAVING count(DISTINCT n % 3 = 1) = 2)),
o AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (stem AND NOT lag(stem) OVER w) THEN 1 ELSE 0 END AS opens, NOT stem AND (q * 2 < 92 OR coalesce(lag(stem) OVER w, true)) AS opt FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS block_no FROM o),
c AS (SELECT *, sum(CASE WHEN opt THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block_no ORDER BY n) AS option_no, CASE WHEN opt AND q * 2 < 92 THEN '' ELSE 'X ' END || 'item' || p AS t FROM b),
s AS (SELECT doc_id, block_no, string_agg(t, ' ' ORDER BY n) AS question FROM c WHERE stem GROUP BY ALL),
a AS (SELECT doc_id, block_no, option_no, string_agg(t, ' ' ORDER BY n) AS t, bool_or(opt AND f = 'R') AS m FROM c WHERE NOT stem GROUP BY ALL),
r AS (SELECT doc_id, block_no, string_agg(t, '|' ORDER BY option_no) AS options, CASE WHEN 2 * count(*) FILTER (m) > count(*) THEN 0 ELSE count(*) FILTER (m) END AS n_marked FROM a GROUP BY ALL)
SELECT doc_id, block_no, coalesce(question, '') AS question, coalesce(options, '') AS options, coalesce(n_marked, 0) AS n_marked FROM s FULL JOIN r USING (doc_id, block_no)""")
def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.drawn_blocks(*_drawn(spark, sf_dir))
    marked = F.size(F.filter("options", lambda o: o["marked"])).cast("long").alias("n_marked")
    return found.select("doc_id", F.col("block_no").cast("long").alias("block_no"), "question", F.array_join(F.transform("options", lambda o: o["text"]), "|").alias("options"), marked)


@query(f"WITH d AS ({SQL['drawn_pages']}) SELECT doc_id, count(*) FILTER (question <> '' AND contains(options, '|'))::BIGINT AS usable FROM d GROUP BY doc_id")
def usable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.usable_blocks(geometry.drawn_blocks(*_drawn(spark, sf_dir)))


PAGE_MEANS = """WITH e AS (SELECT o_orderkey AS doc_id, o_custkey % 50 AS l, o_custkey % 50 + 10 + o_orderkey % 40 AS r FROM orders)
SELECT doc_id, y::BIGINT AS y, avg(least(255, x * 3 + y))::DOUBLE AS red FROM e, range(0, 60) t(x), (SELECT unnest([0, 4, 8]) AS y) WHERE x >= least(l, 59) AND x < least(greatest(least(l, 59) + 1, r), 60) GROUP BY doc_id, y"""


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order; the column of some reaches over the edge."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 50).cast("int").alias("left"), (F.col("o_custkey") % 50 + 10 + F.col("o_orderkey") % 40).cast("int").alias("right"))


@query(PAGE_MEANS)
def page_row_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 60 x 10 pixels, a row for each pixel."""
    rows = page_edges(spark, sf_dir).repartition("doc_id")
    pixels = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(9))))
    shade = F.least(F.lit(255), F.col("x") * 3 + F.col("y"))
    found = geometry.row_means(pixels.withColumns({"red": shade, "green": shade, "blue": shade}), rows)
    return found.select("doc_id", F.col("y").cast("long").alias("y"), "red")


@query(f"SELECT doc_id, family, concat('q-000', q_index) AS draft_card_id FROM ({_QUESTIONS}) WHERE NOT {_KNOWN} OR family <> 'single-choice'")
def blocked_with_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.blocked_with_drafts(_cards(spark, sf_dir, once=False), ["mcq.single"]).select("doc_id", "family", "draft_card_id")


@query(f"SELECT p_partkey AS doc_id, {_KEY} AS deck_key, 3::BIGINT AS card_count, 'draft' AS status, CASE WHEN p_partkey % 4 = 0 THEN '3' ELSE '0' END AS needs_answer, p_brand AS level, CASE WHEN p_size % 2 = 0 THEN 'licensed' ELSE 'unconfirmed' END AS rights FROM part")
def draft_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with envelopes that differ by document."""
    bases = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("licensed"), F.lit("licensed"))).otherwise(F.array(F.lit("licensed"), F.lit("user-authored")))
    docs = quizzes(spark, sf_dir).withColumns({"level": F.col("p_brand"), "rights_bases": bases})
    found = export.draft_decks(text_cards(docs)[1], docs)
    get = lambda path: F.get_json_object("deck", f"$.{path}")
    return found.select("doc_id", "deck_key", "card_count", get("status").alias("status"), get("meta.review.needsAnswer").alias("needs_answer"), get("meta.level").alias("level"), get("meta.source.rightsBasis").alias("rights"))


@query(f"""SELECT p_partkey AS doc_id, 'capture-ir.v1' AS version, {_KEY} AS deck_key, 3::BIGINT AS n_cards, 11::BIGINT AS n_evidence, 'multiple-select' AS second_family, CASE WHEN p_partkey % 4 <> 0 THEN 2 ELSE 0 END::BIGINT AS second_correct,
CASE WHEN p_partkey % 4 = 0 OR p_size % 2 <> 0 THEN 'false' ELSE 'true' END AS third_answer FROM part""")
def capture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir, once=False)
    found = capture_ir.capture_documents(cards, C.evidence(cards), quizzes(spark, sf_dir), ALL_CAPABILITIES)
    get = lambda path: F.get_json_object("document", f"$.{path}")
    size = lambda path: F.json_array_length(get(path)).cast("long")
    return found.select("doc_id", get("schemaVersion").alias("version"), get("deck.deckKey").alias("deck_key"), size("cards").alias("n_cards"), size("evidence").alias("n_evidence"), get("cards[1].family").alias("second_family"), size("cards[1].correctOptionIds").alias("second_correct"), get("cards[2].answer").alias("third_answer"))


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'card 1: is not an object' WHEN 1 THEN concat('card ', p_name, ': ', CASE WHEN p_size % 5 < 2 THEN concat('an mcq card needs at least 2 options; this card has ', p_size % 5, '; card ', p_name, ': ') ELSE '' END,
CASE WHEN p_size % 5 = 1 THEN 'correctAnswer must repeat the text of the correct option' ELSE concat('mark exactly one correct option, ', p_size % 5, ' are marked') END)
WHEN 2 THEN concat('card c: correctOptionIds [''', p_brand, ''', ''a''] does not equal the options flagged isCorrect [''a'']') WHEN 3 THEN 'card 2: option 1 has no text; card 2: mark exactly one correct option, 0 are marked; card 2: duplicate cardId' ELSE 'the deck is not a JSON object' END AS errors FROM part""")
def deck_check_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks that a person has edited: cards and options that are no objects, other counts and ids than declared, no deck."""
    head = '{"schemaId":"learncard.v1","cards":['
    option = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5), lambda k: F.concat(F.lit('{"text":"o'), k.cast("string"), F.lit('","isCorrect":true}'))), ",")
    k = F.col("p_partkey") % 5
    deck = (
        F.when(k == 0, head + '"x"]}')
        .when(k == 1, F.concat(F.lit(head + '{"type":"mcq","cardId":"'), "p_name", F.lit('","question":{"en":7},"correctAnswer":"?","options":['), F.when(F.col("p_size") % 5 > 0, option).otherwise(""), F.lit("]}]}")))
        .when(k == 2, F.concat(F.lit(head + '{"type":"mcq","cardId":"c","selectionMode":"multiple","question":{"en":"q"},"correctOptionIds":["'), "p_brand", F.lit('","a"],"options":[{"optionId":"a","text":"x","isCorrect":true},{"optionId":"b","text":"y"}]}]}')))
        .when(k == 3, F.lit(head + '{"type":"flashcard","cardId":2,"question":{"en":"q"},"front":{"en":"f"},"back":{"en":"b"}},{"type":"mcq","cardId":"2","question":{"en":"q"},"options":["x",{"text":"y"}]}]}'))
        .otherwise(F.concat(F.lit('["'), "p_name", F.lit('"]')))
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), deck.alias("deck"))
    return export.check_decks(rows, ["mcq.multiple-select.v1"]).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH v AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 1 END AS n FROM ({_QUESTIONS}) GROUP BY doc_id) SELECT doc_id, n::BIGINT AS blocking, 0::BIGINT AS warnings, n::BIGINT AS last_issue FROM v")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir, once=False)
    issues = materialized(rules.in_order(rules.validate(cards, C.evidence(cards), ["mcq.single"]), cards), "issues")
    return rules.issue_totals(issues).join(issues.groupBy("doc_id").agg(F.max("issue_no").cast("long").alias("last_issue")), "doc_id")


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS question_fingerprint, 'option ' || l_partkey % 9 AS clean_text FROM lineitem), r AS (SELECT l_orderkey AS question_fingerprint, 'option ' || l_suppkey % 9 AS clean_text, bool_or(l_returnflag = 'R') AS is_correct FROM lineitem GROUP BY ALL)
SELECT q.question_fingerprint, q.clean_text, r.is_correct FROM q LEFT JOIN r USING (question_fingerprint, clean_text)""")
def resolved_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("option "), (F.col(c) % 9).cast("string")).alias("clean_text")
    fingerprint = F.col("l_orderkey").alias("question_fingerprint")
    return captures.resolved_options(rows.select(fingerprint, name("l_partkey")).distinct(), rows.select(fingerprint, name("l_suppkey"), (F.col("l_returnflag") == "R").alias("is_correct")))


_STATES = ("queued", "running", "awaiting_user", "succeeded", "failed")


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third event is sent twice."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), F.get(F.array(*[F.lit(x) for x in _STATES]), (F.col("event_id") % 5).cast("int")).alias("state"), F.col("ts").alias("occurred_at"))
    return rows.unionByName(rows.filter("event_id % 3 = 0"))


_JOB_EVENTS = "SELECT event_id, user_id AS entity_id, ['queued', 'running', 'awaiting_user', 'succeeded', 'failed'][event_id % 5 + 1] AS state, ts FROM events"


@query(f"SELECT entity_id, arg_max(state, (ts, event_id)) AS state, count(*) AS n_events FROM ({_JOB_EVENTS}) GROUP BY entity_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.states(_job_events(spark, sf_dir))


@query(f"""SELECT event_id, entity_id, before, state FROM (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS before FROM ({_JOB_EVENTS})) WHERE state IS DISTINCT FROM before
AND NOT CASE WHEN before IS NULL THEN state = 'queued' ELSE (before || '>' || state) IN ('queued>running', 'running>awaiting_user', 'running>succeeded', 'running>failed', 'running>cancelled') END""")
def job_invalid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.invalid_steps(_job_events(spark, sf_dir), jobs.JOB)


_GOLDEN = """SELECT o_orderkey AS k, o_custkey % 3 <> 0 AS known, o_orderkey % 11 = 0 AS lost, CASE WHEN o_custkey % 5 = 0 THEN 'true-false' ELSE 'single-choice' END = CASE WHEN o_custkey % 4 = 0 THEN 'true-false' ELSE 'single-choice' END AS same_family,
o_custkey % 7 <> 0 AS same_question, o_custkey % 8 <> 0 AS same_order, o_custkey % 6 <> 0 AS same_set, o_custkey % 10 < 7 AS verified FROM orders"""


@query(f"""WITH g AS ({_GOLDEN}), m AS (SELECT avg((same_question AND NOT lost)::INT) AS question_exact, avg((same_order AND NOT lost)::INT) AS options_exact, avg((same_family AND NOT lost)::INT) AS family_accuracy,
avg((same_set AND NOT lost)::INT) FILTER (known) AS correct_set_accuracy, avg((verified AND NOT lost AND NOT (known AND same_set))::INT) AS false_authoritative, avg((NOT (verified AND NOT lost))::INT) FILTER (NOT known) AS blocked_when_unknown,
avg((verified = known AND NOT lost)::INT) AS tier_accuracy FROM g)
SELECT metric, round(value, 9) AS value FROM (UNPIVOT m ON question_exact, options_exact, family_accuracy, correct_set_accuracy, false_authoritative, blocked_when_unknown, tier_accuracy INTO NAME metric VALUE value)""")
def golden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that differ from what was expected in family, question, order of options, answer and tier, or are not found."""
    c, orders = F.col("o_custkey"), table(spark, sf_dir, "orders")
    option = lambda t, right: F.struct(F.lit(t).alias("text"), right.alias("is_correct"))
    a_right = F.lit(True)
    expected = orders.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("block_no"), F.when(c % 5 == 0, "true-false").otherwise("single-choice").alias("family"), F.lit("What  is it?").alias("question"),
        F.array(option("a", a_right), option("b", ~a_right)).alias("options"), F.when(c % 3 != 0, "source-verified").otherwise("source-ambiguous").alias("tier"), (c % 3 != 0).alias("known"),
    )
    same = c % 6 != 0
    in_turn = F.array(option("a", same), option("b", ~same))
    found = orders.filter("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("block_no"), F.when(c % 4 == 0, "true-false").otherwise("single-choice").alias("family"), F.when(c % 7 != 0, " What is it? ").otherwise("What?").alias("question"),
        F.when(c % 8 != 0, in_turn).otherwise(F.reverse(in_turn)).alias("options"), F.when(c % 10 < 7, "source-verified").otherwise("source-ambiguous").alias("tier"),
    )
    return metrics.golden(expected, found).select("metric", F.round("value", 9).alias("value"))
