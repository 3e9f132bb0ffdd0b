"""Projection of cards to a target deck: gates, decks, drafts and the check of an edited deck."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import patterns as P
from quizloom.functions.tables import dealt, materialized
from quizloom.functions.text import deck_key

MIN_OPTIONS = 2


def _declared(capabilities: list[str], name: str) -> Column:
    return F.lit(name in capabilities)


def block_reason(capabilities: list[str]) -> Column:
    """Why a card may not be exported, by the first gate that stops it; null if it may."""
    n = F.size("options")
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    family = F.col("family")
    tiers = ", ".join(f"'{t}'" for t in sorted(P.VERIFIED_TIERS))
    several, two = P.CAPABILITY["multiple-select"], P.CAPABILITY["true-false"]
    few = F.format_string(f"an mcq card needs at least {MIN_OPTIONS} options; this card has %d", n)
    return (
        F.when(F.col("tier").isNull(), "no answerEvidenceTier; an unevidenced answer cannot be exported")
        .when(~F.col("tier").isin(*P.VERIFIED_TIERS), F.concat(F.lit("answerEvidenceTier '"), F.col("tier"), F.lit(f"' is not exportable; needs one of [{tiers}]")))
        .when((family == "multiple-select") & ~_declared(capabilities, several), f"target does not declare {several}")
        .when((family == "true-false") & ~_declared(capabilities, two), f"target does not declare {two}")
        .when((family == "single-choice") & (n < MIN_OPTIONS), few)
        .when((family == "single-choice") & (right != 1), F.format_string("single-choice needs exactly one correct option, has %d", right))
        .when((family == "flashcard") & (F.col("front").isNull() | F.col("back").isNull()), "flashcard needs front and back")
        .when((family == "true-false") & (F.col("answer").isNull() | F.col("true_label").isNull()), "true-false needs an answer and both labels")
        .when((family == "multiple-select") & (n < MIN_OPTIONS), few)
        .when((family == "multiple-select") & (right == 0), "multiple-select needs at least one correct option")
        .when(~family.isin(*P.DRAFTABLE), F.concat(F.lit("family '"), family, F.lit("' is not supported by this target profile")))
    )


def _whole(cards: DataFrame) -> DataFrame:
    for c in ("front", "back"):
        if c not in cards.columns:
            cards = cards.withColumn(c, F.lit(None).cast("string"))
    return cards.filter("reject is null") if "reject" in cards.columns else cards


def gated(cards: DataFrame, capabilities: list[str]) -> DataFrame:
    """cards with reason; exported ones have sequence, q-0001 and on in document order."""
    rows = _whole(cards).withColumn("reason", block_reason(capabilities))
    order = Window.partitionBy("doc_id", F.col("reason").isNull()).orderBy("block_no")
    return rows.withColumn("sequence", F.when(F.col("reason").isNull(), F.format_string("q-%04d", F.row_number().over(order))))


def blocked(cards: DataFrame, capabilities: list[str]) -> DataFrame:
    return gated(cards, capabilities).filter("reason is not null").select("doc_id", "card_id", "family", "reason")


def _text_options(keep: Column | None = None) -> Column:
    right = lambda o: o["is_correct"] if keep is None else o["is_correct"] & keep
    return F.transform("options", lambda o: F.struct(o["text"].alias("text"), right(o).alias("isCorrect")))


def card_json(draft: bool = False) -> Column:
    """The card as JSON of the target, by family. In a draft, answers without evidence stay empty."""
    keep = F.col("tier").isin(*P.VERIFIED_TIERS) if draft else F.lit(True)
    question = F.create_map("locale", "question")
    base = [F.col("sequence").alias("cardId"), F.lit("mcq").alias("type")]
    best = F.struct(F.lit("single-best-answer").alias("mode"), F.lit(1).alias("points")).alias("scoring")
    right = F.filter("options", lambda o: o["is_correct"] & keep)
    review = [F.col("review")] if draft else []
    answer = F.coalesce(F.get(right, F.lit(0))["text"], F.lit(""))
    single = F.struct(*base, F.col("source_id").alias("sourceId"), question.alias("question"), answer.alias("correctAnswer"), _text_options(keep).alias("options"), best, *review)
    told = F.col("answer").isNotNull() & keep
    tf_answer = F.when(~told, "").when(F.col("answer"), F.col("true_label")).otherwise(F.col("false_label"))
    tf_options = F.array(F.struct(F.col("true_label").alias("text"), (told & F.col("answer")).alias("isCorrect")), F.struct(F.col("false_label").alias("text"), (told & ~F.col("answer")).alias("isCorrect")))
    two = F.struct(*base, F.lit("true-false").alias("sourceFormat"), F.col("source_id").alias("sourceId"), question.alias("question"), tf_answer.alias("correctAnswer"), tf_options.alias("options"), best, *review)
    ids = F.transform("options", lambda o: F.struct(o["option_id"].alias("optionId"), o["text"].alias("text"), (o["is_correct"] & keep).alias("isCorrect")))
    every = F.struct(F.lit("all-or-nothing").alias("mode"), F.lit(1.0).alias("points")).alias("scoring")
    several = F.struct(*base, F.lit("multiple").alias("selectionMode"), F.col("source_id").alias("sourceId"), question.alias("question"), ids.alias("options"), F.transform(right, lambda o: o["option_id"]).alias("correctOptionIds"), every, *review)
    flash = F.struct(F.col("sequence").alias("cardId"), F.lit("flashcard").alias("type"), F.col("source_id").alias("sourceId"), F.create_map("locale", "front").alias("question"), F.create_map("locale", "front").alias("front"), F.create_map("locale", "back").alias("back"), *review)
    return F.when(F.col("family") == "flashcard", F.to_json(flash)).when(F.col("family") == "true-false", F.to_json(two)).when(F.col("family") == "multiple-select", F.to_json(several)).otherwise(F.to_json(single))


def rights_basis(bases: Column) -> Column:
    distinct = F.array_distinct(bases)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise("unconfirmed")


@dataclass(frozen=True)
class Envelope:
    """What a deck says of itself beyond its cards. A column of docs with the name of a field takes its place."""

    level: str = "general"
    difficulty: str = "intermediate"
    tags: tuple[str, ...] = ("captured",)
    source_kind: str = "text-input"
    rights_bases: tuple[str, ...] = ("user-authored",)
    estimated_minutes: int | None = None

    def column(self, name: str, docs: DataFrame) -> Column:
        value = getattr(self, name)
        given = F.array(*[F.lit(v) for v in value]).cast("array<string>") if isinstance(value, tuple) else F.lit(value)
        return (F.coalesce(F.col(name), given) if name in docs.columns else given).alias(name)


def decks(cards: DataFrame, docs: DataFrame, capabilities: list[str], target: str = P.TARGET, envelope: Envelope | None = None) -> DataFrame:
    """doc_id, deck_key, card_count, deck (JSON) of every document that exports a card."""
    # dealt by document once, cards are numbered, grouped and joined where they are
    rows = gated(dealt(cards, "doc_id"), capabilities).filter("reason is null")
    held = rows.groupBy("doc_id", "locale").agg(F.array_sort(F.collect_list(F.struct("sequence", card_json().alias("card")))).alias("cards"))
    return _decks(held, docs, target, envelope or Envelope(), None)


def _decks(held: DataFrame, docs: DataFrame, target: str, envelope: Envelope, review: Column | None) -> DataFrame:
    told = docs.select("doc_id", "title", *[envelope.column(f.name, docs) for f in fields(Envelope)])
    # titles are few bytes on disk, but one for each document: each task meets those of its own documents, none is broadcast
    rows = held.join(told.hint("shuffle_hash"), "doc_id").withColumn("deck_key", deck_key(F.col("title")))
    count = F.size("cards")
    meta = [
        F.create_map("locale", "title").alias("title"), "level", "tags", "difficulty", F.coalesce("estimated_minutes", count).alias("estimatedMinutes"), count.alias("cardCount"),
        F.struct(F.col("locale").alias("source"), F.col("locale").alias("target")).alias("languages"),
        F.struct(F.col("source_kind").alias("kind"), rights_basis(F.col("rights_bases")).alias("rightsBasis")).alias("source"),
    ]
    meta += [] if review is None else [review.alias("review")]
    body = F.array_join(F.transform("cards", lambda c: c["card"]), ",")
    status = "" if review is None else '"status":"draft",'
    deck = F.concat(F.lit(f'{{"schemaId":{json.dumps(target)},{status}"deckKey":"'), F.col("deck_key"), F.lit('","bookKey":null,"meta":'), F.to_json(F.struct(*meta)), F.lit(',"cards":['), body, F.lit("]}"))
    return rows.select("doc_id", "deck_key", count.cast("long").alias("card_count"), deck.alias("deck"))


def write_decks(decks: DataFrame, path: str) -> None:
    """A line of JSON for each deck, in files under path."""
    decks.select(F.col("deck").alias("value")).write.text(path)


def drafts(cards: DataFrame) -> DataFrame:
    """Draftable cards with their sequence, review status and reasons, and the draft as JSON."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    rows = _whole(cards).filter(F.col("family").isin(*P.DRAFTABLE)).withColumn("sequence", F.format_string("q-%04d", F.row_number().over(order)))
    keep = F.coalesce(F.col("tier").isin(*P.VERIFIED_TIERS), F.lit(False))
    answered = F.when(F.col("family") == "flashcard", F.col("front").isNotNull() & F.col("back").isNotNull()).when(F.col("family") == "true-false", F.col("answer").isNotNull() & keep).otherwise(F.exists("options", lambda o: o["is_correct"]) & keep)
    why = F.when(~answered & ~keep & F.col("tier").isNotNull(), F.concat(F.col("blocking"), F.array(F.concat(F.lit("answer evidence is '"), F.col("tier"), F.lit("', which cannot be exported")))))
    why = why.when(~answered & (F.size("blocking") == 0), F.array(F.lit("the material does not state which option is correct"))).otherwise(F.col("blocking"))
    status = F.when(~answered, "needs-answer").when(F.size("blocking") > 0, "needs-review").otherwise("ready")
    rows = rows.withColumns({"answered": answered, "status": status, "reasons": why})
    rows = rows.withColumn("review", F.struct("status", "answered", F.when(F.size("reasons") > 0, F.col("reasons")).alias("reasons"), F.col("tier").alias("answerEvidenceTier")))
    return rows.select("doc_id", "block_no", "card_id", "sequence", "family", "status", "answered", "reasons", card_json(draft=True).alias("draft"))


def draft_summary(drafted: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return drafted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cards"), count("needs-answer").alias("needs_answer"), count("needs-review").alias("needs_review"), count("ready").alias("ready"))


def draft_decks(cards: DataFrame, docs: DataFrame, target: str = P.TARGET, envelope: Envelope | None = None) -> DataFrame:
    """doc_id, deck_key, card_count and deck (JSON) of every document with a card that the target could hold; the deck says
    that it is a draft, and how many cards still need what."""
    rows = drafts(cards)
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col("draft").alias("card")))).alias("cards"))
    counts, locales = draft_summary(rows).withColumnRenamed("cards", "n"), cards.groupBy("doc_id").agg(F.min("locale").alias("locale"))
    held = held.join(counts.hint("shuffle_hash"), "doc_id").join(locales.hint("shuffle_hash"), "doc_id")
    review = F.struct(F.col("n").alias("cards"), F.col("needs_answer").alias("needsAnswer"), F.col("needs_review").alias("needsReview"), F.col("ready").alias("ready"))
    return _decks(held, docs, target, envelope or Envelope(), review)


def draft_ids(cards: DataFrame) -> DataFrame:
    """doc_id, card_id and the number that the card has in the draft deck."""
    return drafts(cards).select("doc_id", "card_id", F.col("sequence").alias("draft_card_id"))


def blocked_with_drafts(cards: DataFrame, capabilities: list[str]) -> DataFrame:
    """Blocked cards with their number in the draft deck; null for those that no draft can hold."""
    return blocked(cards, capabilities).join(draft_ids(cards), ["doc_id", "card_id"], "left")


_LIST = "array<variant>"


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _written(value: Column) -> Column:
    """A value as messages and comparisons write it: a null that is there as None, truths in capitals, others as in JSON; null if
    there is no such key. (Numbers with a fraction and nested values are compared as JSON writes them.)"""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(text, F.to_json(value)))


def _holds(value: Column) -> Column:
    """Whether a value counts as true: all do but false, null, zero, and empty strings, lists and objects."""
    text = F.try_variant_get(value, "$", "string")
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(value, "$", "double") == 0)
    empty = F.schema_of_variant(value).isin("VOID", "ARRAY<VOID>", "OBJECT<>") & (F.coalesce(F.to_json(value), F.lit("null")).isin("null", "[]", "{}"))
    return F.coalesce(value.isNotNull() & ~empty & ~number & (F.coalesce(text, F.lit("x")) != "") & ~((F.schema_of_variant(value) == "BOOLEAN") & (text == "false")), F.lit(False))


def _is_text(value: Column) -> Column:
    """Whether something other than white space is written there."""
    return F.trim(F.coalesce(_written(value), F.lit(""))) != ""


def _repr(value: Column) -> Column:
    """A value in a message: strings in quotes, what is missing as None."""
    text = F.coalesce(_written(value), F.lit("None"))
    return F.when(F.schema_of_variant(value) == "STRING", F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)


def _quoted(values: Column) -> Column:
    """A list of strings as the messages write it."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def _card_errors(card: Column, where: Column, capabilities: list[str]) -> Column:
    """Messages on one card that is an object, in order. Their wording."""
    say = lambda cond, text: F.when(cond, F.concat(where, F.lit(": "), text if isinstance(text, Column) else F.lit(text)))
    blank = lambda key: F.coalesce(~F.exists(F.map_values(_get(card, key, "map<string,variant>")), _is_text), F.lit(True))
    kind = F.when(F.schema_of_variant(_get(card, "type", "variant")) == "STRING", _get(card, "type"))
    mcq, flash = F.coalesce(kind == "mcq", F.lit(False)), F.coalesce(kind == "flashcard", F.lit(False))
    options = _get(card, "options", _LIST)
    listed, n = mcq & options.isNotNull(), F.coalesce(F.size(options), F.lit(0))
    two = F.coalesce(_get(card, "sourceFormat") == "true-false", F.lit(False))
    several = F.coalesce(_get(card, "selectionMode") == "multiple", F.lit(False))
    many, only = listed & several, listed & ~several
    any_of = lambda o, key: _get(o, key, "variant")
    right = F.filter(options, lambda o: _is_object(o) & _holds(any_of(o, "isCorrect")))
    distinct = lambda c: F.array_sort(F.array_distinct(c))
    ids = F.coalesce(distinct(_get(card, "correctOptionIds", "array<string>")), F.array().cast("array<string>"))
    flagged = F.coalesce(distinct(F.transform(right, lambda o: F.coalesce(_written(any_of(o, "optionId")), F.lit("None")))), F.array().cast("array<string>"))
    empty = F.transform(options, lambda o, k: F.when(~(_is_object(o) & _is_text(any_of(o, "text"))), F.concat(where, F.lit(": option "), (k + 1).cast("string"), F.lit(" has no text"))))
    answer, stated = _written(any_of(card, "correctAnswer")), _written(any_of(F.get(right, F.lit(0)), "text"))
    first = F.array(
        say(blank("question"), "the question is empty"),
        say(mcq & options.isNull(), "mcq needs an options list"),
        say(listed & two & (n != 2), F.format_string("a true/false card needs exactly 2 options, has %d", n)),
        say(listed & ~two & (n < MIN_OPTIONS), F.format_string(f"an mcq card needs at least {MIN_OPTIONS} options; this card has %d", n)),
    )
    after = F.array(
        say(many & ~_declared(capabilities, P.CAPABILITY["multiple-select"]), f"the target does not declare {P.CAPABILITY['multiple-select']}"),
        say(many & (F.size(ids) == 0), "mark at least one correct option (correctOptionIds is empty)"),
        say(many & (F.size(ids) > 0) & (flagged != ids), F.concat(F.lit("correctOptionIds "), _quoted(ids), F.lit(" does not equal the options flagged isCorrect "), _quoted(flagged))),
        say(only & two & ~_declared(capabilities, P.CAPABILITY["true-false"]), f"the target does not declare {P.CAPABILITY['true-false']}"),
        say(only & (F.size(right) != 1), F.format_string("mark exactly one correct option, %d are marked", F.size(right))),
        say(only & (F.size(right) == 1) & (F.trim(F.coalesce(answer, F.lit(""))) != F.trim(F.coalesce(stated, F.lit("")))), "correctAnswer must repeat the text of the correct option"),
        say(flash & blank("front"), "the flashcard front is empty"),
        say(flash & blank("back"), "the flashcard back is empty"),
        say(~mcq & ~flash, F.concat(F.lit("type "), _repr(any_of(card, "type")), F.lit(" is not supported by this target profile"))),
    )
    return F.array_compact(F.concat(first, F.when(listed, empty).otherwise(F.array().cast("array<string>")), after))


def check_decks(decks: DataFrame, capabilities: list[str], target: str = P.TARGET) -> DataFrame:
    """doc_id and errors (in order) of decks given as JSON in `deck`: a person's edit, so nothing is taken for granted of the
    kinds of its values. Text that is no JSON object is one error."""
    # a deck is read for its head and for its cards: it is written once, not made twice
    rows = materialized(decks.select("doc_id", "deck"), "edited_decks").select("doc_id", F.try_parse_json("deck").alias("deck"))
    rows = rows.withColumns({"ok": _is_object(F.col("deck")), "schema": _get(F.col("deck"), "schemaId", "variant")})
    cards = rows.filter("ok").select("doc_id", F.posexplode(_get(F.col("deck"), "cards", _LIST)).alias("at", "card")).withColumn("object", _is_object(F.col("card")))
    key = _get(F.col("card"), "cardId", "variant")
    name = F.when(_holds(key), _written(key))
    number = (F.col("at") + 1).cast("string")
    where = F.concat(F.lit("card "), F.when(F.col("object"), F.coalesce(name, number)).otherwise(number))
    cards = cards.withColumns({"where": where, "id": F.when(F.col("object"), F.coalesce(_written(key), F.lit("")))})
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("at")) > 1
    cards = cards.withColumn("again", again & F.col("id").isNotNull())
    none = F.array().cast("array<string>")
    own = F.when(~F.col("object"), F.array(F.concat("where", F.lit(": is not an object")))).otherwise(_card_errors(F.col("card"), F.col("where"), capabilities))
    repeated = F.when(F.col("again"), F.array(F.concat(F.lit("card "), "id", F.lit(": duplicate cardId")))).otherwise(none)
    held = cards.select("doc_id", "at", F.concat(own, repeated).alias("e")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"])).alias("body"))
    found = _repr(F.col("schema"))
    head = F.when((F.schema_of_variant(F.col("schema")) == "STRING") & (_written(F.col("schema")) == target), none).otherwise(F.array(F.concat(F.lit(f"schemaId must be '{target}', found "), found)))
    body = F.coalesce("body", F.array(F.lit("the deck has no cards")))
    errors = F.when(F.col("ok"), F.concat(head, body)).otherwise(F.array(F.lit("the deck is not a JSON object")))
    return rows.select("doc_id", "ok", "schema").join(held, "doc_id", "left").select("doc_id", errors.alias("errors"))


def finalize_decks(decks: DataFrame) -> DataFrame:
    """Decks without the notes of a draft; keys that are not known here stay."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("deck").to_pylist():
                deck = json.loads(text) if text else None
                if isinstance(deck, dict):
                    deck.pop("status", None)
                    if isinstance(deck.get("meta"), dict):
                        deck["meta"].pop("review", None)
                    for card in deck.get("cards") or []:
                        if isinstance(card, dict):
                            card.pop("review", None)
                out.append(None if deck is None else json.dumps(deck, ensure_ascii=False, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "deck"])

    kind = decks.schema["doc_id"].dataType.simpleString()
    return decks.select("doc_id", "deck").mapInArrow(plain, f"doc_id {kind}, deck string")
