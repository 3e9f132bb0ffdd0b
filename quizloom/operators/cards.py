"""Cards from question blocks: answers are bound from what the material states, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import identity, quality
from quizloom.functions import patterns as P
from quizloom.functions.text import answer_norm, cleaned_all, family, fold_letters, normalized

DEFAULTS = {"origin": "file://local", "path": "/upload", "captured_at": "1970-01-01T00:00:00Z", "session_id": "ses_local", "run_id": "run_local", "evidence_kind": "ocr", "locale": "und"}


def with_defaults(docs: DataFrame) -> DataFrame:
    """docs with the intake columns that are not there filled with their defaults."""
    return docs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in docs.columns else F.lit(v) for k, v in DEFAULTS.items()})


def _letter(pos: Column) -> Column:
    """A to Z by position; null beyond."""
    return F.when(pos < 26, F.char(pos + 65))


def resolved(blocks: DataFrame, key: DataFrame) -> DataFrame:
    """blocks with letters and answer_source: a line that states the answer, else the key, else marks, else none."""
    # joined by document, as blocks and keys are grouped, so that blocks stay where they are
    keys = key.groupBy("doc_id").agg(F.collect_list(F.struct("q_index", "letters")).alias("_keys")).hint("shuffle_hash")
    own = F.filter("_keys", lambda k: k["q_index"] == F.col("q_index"))
    rows = blocks.join(keys, "doc_id", "left").withColumn("key_letters", F.get(own, F.lit(0))["letters"]).drop("_keys")
    marks = F.transform(F.filter("options", lambda o: o["marked"] & (o["pos"] < 26)), lambda o: F.coalesce(o["marker"], _letter(o["pos"])))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    inline, keyed, marked = has(F.col("inline_letters")), has(F.col("key_letters")), F.size(marks) > 0
    source = F.when(inline, "inline").when(keyed, "answer-key").when(marked, "inline-mark").otherwise("none")
    letters = F.when(inline, F.col("inline_letters")).when(keyed, F.col("key_letters")).when(marked, marks).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"answer_source": source, "letters": letters}).drop("key_letters", "inline_letters")


def cards(resolved_blocks: DataFrame, docs: DataFrame, python: bool = False, by_position: bool = True) -> DataFrame:
    """A row for each block: card columns, or `reject` where the block cannot be a card.

    The intake columns are taken from docs, unless the blocks have them already. by_position: a key letter also picks the option at that place, whatever its own letter; otherwise only options
    without a letter are picked by place.
    """
    known = all(c in resolved_blocks.columns for c in DEFAULTS)
    rows = resolved_blocks if known else resolved_blocks.join(with_defaults(docs).select("doc_id", *DEFAULTS), "doc_id")
    markers = F.transform("options", lambda o: F.upper(F.coalesce(o["marker"], F.lit(""))))
    rows = rows.withColumn("wanted", F.transform(fold_letters(F.col("letters"), markers), F.upper))
    rows = rows.withColumn("_texts", cleaned_all(F.transform("options", lambda o: o["text"]), python))
    rows = rows.withColumn("_texts", F.transform("_texts", quality.fold_homoglyphs))

    def flag(o: Column) -> Column:
        place = _letter(o["pos"])
        own = F.array_contains("wanted", F.upper(F.coalesce(o["marker"], place)))
        at_place = F.array_contains("wanted", place)
        return F.coalesce(own | (at_place if by_position else (o["marker"].isNull() & at_place)), F.lit(False))

    rows = rows.withColumn("_flags", F.transform("options", flag)).withColumn("n_correct", F.size(F.filter("_flags", lambda f: f)))
    reject = F.when(F.col("question") == "", "no-question-text").when(F.size("options") < 2, "too-few-options")
    rows = rows.withColumns({"reject": reject, "stem": normalized(F.col("question"), python), "family": family(F.col("question"), F.col("_texts"), F.col("n_correct"))})
    fingerprint = identity.question_fingerprint(F.col("origin"), F.col("path"), F.col("family"), F.col("stem"), F.col("_texts"))
    rows = rows.withColumn("source_id", identity.source_id(F.col("origin"), F.col("path"), fingerprint))
    correct = F.transform(F.filter(F.arrays_zip(F.col("_texts").alias("t"), F.col("_flags").alias("f")), lambda x: x["f"]), lambda x: x["t"])
    rows = rows.withColumn("_damage", F.filter(F.transform(correct, quality.reasons), lambda r: F.size(r) > 0))
    unread = (F.col("n_correct") > 0) & (F.size("_damage") > 0)
    known = F.col("answer_source") != "none"
    told = F.array_compact(
        F.array(
            F.when(~known, "no-answer-key"),
            F.when(known & (F.col("n_correct") == 0), "answer-key-unresolved"),
            F.when((F.col("family") == "multiple-select") & (F.col("n_correct") < 2) & known, "ambiguous-family"),
            F.when(unread, "unreadable-answer-text"),
        )
    )
    blocking = F.array_sort(F.array_distinct(F.concat(told, F.when(unread, F.get("_damage", F.lit(0))).otherwise(F.array().cast("array<string>")))))
    options = F.transform(
        F.arrays_zip(F.col("_texts").alias("t"), F.col("_flags").alias("f")),
        lambda x, i: F.struct(i.cast("int").alias("pos"), identity.option_id(F.col("source_id"), x["t"]).alias("option_id"), x["t"].alias("text"), x["f"].alias("is_correct"),
                              F.concat(F.lit("ev_"), F.substring("source_id", 1, 16), F.lit("_opt"), i.cast("string")).alias("evidence_id")),
    )
    rows = rows.withColumns({"options": options, "tier": F.when((F.col("n_correct") > 0) & ~unread, "source-verified").otherwise("source-ambiguous"), "blocking": blocking})
    is_tf = F.col("family") == "true-false"
    first_true = F.filter("options", lambda o: answer_norm(o["text"]).isin([t for t, _ in P.TRUE_FALSE]))
    true_option = F.coalesce(F.get(first_true, F.lit(0)), F.get("options", F.lit(0)))
    rows = rows.withColumn("_true", F.when(is_tf, true_option))
    false_option = F.get(F.filter("options", lambda o: o["pos"] != F.col("_true.pos")), F.lit(0))
    return rows.withColumns({
        "card_id": identity.card_id(F.col("source_id")), "draft_id": identity.text_draft_id(F.col("source_id"), F.col("family")),
        "answer": F.when(is_tf, F.col("_true.is_correct")), "true_label": F.when(is_tf, F.col("_true.text")), "false_label": F.when(is_tf, false_option["text"]),
        "correct_option_ids": F.when(~is_tf, F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["option_id"])),
    }).select("doc_id", "block_no", "q_index", "reject", "card_id", "draft_id", "source_id", "family", "question", "options", "correct_option_ids", "n_correct", "answer_source", "tier", "blocking", "answer", "true_label", "false_label", "locale", "evidence_kind", "run_id")


def evidence(cards: DataFrame) -> DataFrame:
    """The ledger: a row for each stem and option of each card, with its role and authority."""
    stem = F.struct(F.concat(F.lit("ev_"), F.substring("source_id", 1, 16), F.lit("_stem")).alias("evidence_id"), F.lit("question").alias("role"), F.lit("content").alias("authority"))
    own = F.transform("options", lambda o: F.struct(o["evidence_id"].alias("evidence_id"), F.lit("option").alias("role"), F.when(o["is_correct"], "solution").otherwise("content").alias("authority")))
    rows = cards.filter("reject is null").select("doc_id", "card_id", "evidence_kind", "run_id", F.explode(F.concat(F.array(stem), own)).alias("e"))
    return rows.select("doc_id", "card_id", "e.*", F.col("evidence_kind").alias("kind"), F.lit("text-v1").alias("extractor"), "run_id")


def unsupported(cards: DataFrame) -> DataFrame:
    """Blocks that are no cards, by name."""
    return cards.filter("reject is not null").select("doc_id", F.concat(F.lit("block-"), F.col("q_index").cast("string")).alias("key"), "reject")


def options(cards: DataFrame) -> DataFrame:
    return cards.filter("reject is null").select("doc_id", "card_id", F.explode("options").alias("o")).select("doc_id", "card_id", "o.*")
