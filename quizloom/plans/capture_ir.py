"""Cards with their evidence as one JSON document for each source document.

Members that a document must have are written even if they are null; members that only some families have are left out of
the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import identity
from quizloom.functions import patterns as P
from quizloom.functions.text import deck_key
from quizloom.operators.cards import with_defaults

# What is said of every document that a person supplies.
VERSION = "capture-ir.v1"
POLICY = "first-party-owned"
RIGHTS = "user-authored"
DESCRIPTION = "Extracted from supplied material."


def _member(name: str, value: Column, when: Column | None = None) -> Column:
    """`"name":value` of a JSON object; null where it is not to be there."""
    text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    return text if when is None else F.when(when, text)


def _raw(name: str, json: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(f'"{name}":'), json)
    return text if when is None else F.when(when, text)


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _field(value: str, evidence: Column) -> Column:
    """A text in the locale of the card, with its evidence."""
    return F.struct(F.create_map("locale", value).alias("value"), F.array(evidence).alias("evidence"), F.lit(1.0).alias("confidence"))


def card_document(cards: DataFrame) -> Column:
    """The card as JSON. Cards of pages have front and back as well."""
    family = F.col("family")
    choice, two, flash = family.isin("single-choice", "multiple-select"), family == "true-false", family == "flashcard"
    stem = F.concat(F.lit("ev_"), F.substring("source_id", 1, 16), F.lit("_stem"))
    prompt = _field("question", stem)
    none = F.lit(None).cast("string")
    review = F.struct(F.lit("needs-review").alias("status"), F.col("blocking").alias("blockingReasons"), none.alias("reviewedBy"), none.alias("reviewedAt"))
    rights = F.struct(F.lit(RIGHTS).alias("basis"), none.alias("licenseNotes"), F.lit(False).alias("approvedForPublication"))
    options = F.transform("options", lambda o: F.struct(o["option_id"].alias("optionId"), o["text"].alias("text"), o["is_correct"].alias("isCorrect")))
    scoring = F.struct(F.lit("all-or-nothing").alias("mode"), F.lit(1.0).alias("points"))
    labels = F.create_map(F.lit("true"), F.col("true_label"), F.lit("false"), F.col("false_label"))
    sides = [_member(side, _field(side, F.concat(stem, F.lit(f"_{side}"))), flash) for side in ("front", "back") if side in cards.columns]
    return _object(
        _member("draftId", F.col("draft_id")), _member("cardId", F.col("card_id")), _member("sourceId", F.col("source_id")), _member("family", family), _member("prompt", prompt),
        _member("review", review), _member("rights", rights), _member("answerEvidenceTier", F.col("tier"), F.col("tier").isNotNull()),
        _member("options", options, choice), _member("correctOptionIds", F.col("correct_option_ids"), choice), _member("scoring", scoring, family == "multiple-select"),
        _member("statement", prompt, two), _member("answer", F.col("answer"), two), _member("labels", labels, two), *sides,
    )


def capture_documents(cards: DataFrame, ledger: DataFrame, docs: DataFrame, capabilities: list[str], source_kind: str = "text-input", target: str = P.TARGET) -> DataFrame:
    """doc_id and document (JSON) for every document of docs (doc_id, title), with or without cards."""
    whole = cards.filter("reject is null")
    own = whole.select("doc_id", F.struct("block_no", card_document(whole).alias("json")).alias("c")).groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("cards"))
    base = with_defaults(docs)
    told = base.select("doc_id", "title", "locale", "origin", "path", "captured_at", "session_id", identity.run_capture_id(F.col("captured_at"), F.col("origin"), F.col("path"), F.lit("question")).alias("capture_id"))
    one = F.struct(
        F.col("evidence_id").alias("evidenceId"), "kind", F.col("capture_id").alias("captureId"), F.col("role").alias("sourceRole"), "authority", "extractor", F.col("run_id").alias("runId")
    )
    evidence = ledger.join(told.select("doc_id", "capture_id"), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    rows = told.join(own, "doc_id", "left").join(evidence, "doc_id", "left")
    text = lambda value: F.create_map("locale", value)
    deck = _object(
        _member("deckKey", deck_key(F.col("title"))), _member("bookKey", F.lit(None).cast("string")), _member("title", text("title")), _member("description", text(F.lit(DESCRIPTION))), _member("level", F.lit("general")),
        _member("difficulty", F.lit("intermediate")), _member("languages", F.struct(F.col("locale").alias("source"), F.col("locale").alias("target"))), _member("tags", F.array(F.lit("captured"))),
    )
    source = F.struct(F.lit(source_kind).alias("kind"), F.lit(POLICY).alias("policy"), "origin", "path", F.col("captured_at").alias("capturedAt"))
    declared = F.struct(F.lit(target).alias("profile"), F.array(*[F.lit(c) for c in sorted(capabilities)]).cast("array<string>").alias("capabilities"))
    listed = F.coalesce(F.array_join(F.transform("cards", lambda c: c["json"]), ","), F.lit(""))
    ledger_json = F.coalesce(F.to_json("evidence"), F.lit("[]"))
    document = _object(
        _member("schemaVersion", F.lit(VERSION)), _member("sessionId", F.col("session_id")), _member("source", source), _member("target", declared), _raw("deck", deck), _raw("evidence", ledger_json),
        _raw("cards", F.concat(F.lit("["), listed, F.lit("]"))),
    )
    return rows.select("doc_id", document.alias("document"))
