"""Cross-row rules over cards, and what a target can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import patterns as P


def _issue(rows: DataFrame, code: str, order: int, message: Column) -> DataFrame:
    card = F.col("card_id") if "card_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("doc_id", card.alias("card_id"), F.lit(code).alias("code"), F.lit(order).alias("rule_order"), message.alias("message"))


def option_set_mismatch(cards: DataFrame) -> DataFrame:
    flagged = F.array_sort(F.array_distinct(F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["option_id"])))
    bad = cards.filter(F.col("correct_option_ids").isNotNull() & (flagged != F.array_sort(F.array_distinct("correct_option_ids"))))
    return _issue(bad, "option-set-mismatch", 3, F.lit("the declared correct options are not those flagged"))


def duplicate_options(options: DataFrame) -> DataFrame:
    bad = options.groupBy("doc_id", "card_id", "option_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return _issue(bad, "duplicate-option-id", 4, F.format_string("option %s appears %d times", "option_id", "times"))


def duplicate_cards(cards: DataFrame) -> DataFrame:
    bad = cards.groupBy("doc_id", "card_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    return _issue(bad, "duplicate-card-id", 2, F.format_string("card appears %d times", "times"))


def dangling_evidence(referenced: DataFrame, ledger: DataFrame) -> DataFrame:
    """referenced and ledger: doc_id, evidence_id. An issue for each document with references that the ledger lacks."""
    missing = referenced.select("doc_id", "evidence_id").distinct().join(ledger.select("doc_id", "evidence_id"), ["doc_id", "evidence_id"], "left_anti")
    found = missing.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ", ").alias("ids"))
    return _issue(found, "dangling-evidence", 1, F.concat(F.lit("not in the ledger: "), F.col("ids")))


def family_rules(cards: DataFrame) -> DataFrame:
    """Needs family, correct_option_ids, true_label, false_label; uses front, back, acceptable where they are."""
    n = F.coalesce(F.size(F.array_distinct("correct_option_ids")), F.lit(0))
    have = lambda c, kind: F.col(c) if c in cards.columns else F.lit(None).cast(kind)
    is_family = lambda f: F.col("family") == f
    codes = F.array_compact(
        F.array(
            F.when(is_family("single-choice") & (n != 1), "single-choice-cardinality"),
            F.when(is_family("multiple-select") & (n == 0), "multiple-select-empty"),
            F.when(is_family("true-false") & (have("true_label", "string").isNull() | have("false_label", "string").isNull()), "true-false-labels"),
            F.when(is_family("typed") & (F.coalesce(F.size(have("acceptable", "array<string>")), F.lit(0)) <= 0), "typed-no-answer"),
            F.when(is_family("flashcard") & (have("front", "string").isNull() | have("back", "string").isNull()), "flashcard-incomplete"),
        )
    )
    rows = cards.select("doc_id", "card_id", F.explode(codes).alias("code"))
    return rows.select("doc_id", "card_id", "code", F.lit(5).alias("rule_order"), F.lit("the card does not fit its family").alias("message"))


def matching_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs: doc_id, card_id, left_item_id, right_item_id; items: doc_id, card_id, side, item_id."""
    on = ["doc_id", "card_id"]
    left, right = (items.filter(F.col("side") == s).select(*on, F.col("item_id").alias(f"{s}_item_id")) for s in ("left", "right"))
    bad = pairs.join(left, [*on, "left_item_id"], "left_anti").unionByName(pairs.join(right, [*on, "right_item_id"], "left_anti")).distinct()
    return _issue(bad, "matching-dangling-pair", 5, F.concat_ws(" - ", "left_item_id", "right_item_id"))


def unresolved_review(cards: DataFrame) -> DataFrame:
    return _issue(cards.filter(F.size("blocking") > 0), "unresolved-review", 6, F.array_join("blocking", ", "))


def evidence_tier(cards: DataFrame) -> DataFrame:
    missing = _issue(cards.filter("tier is null"), "missing-evidence-tier", 7, F.lit("no tier"))
    return missing.unionByName(_issue(cards.filter(~F.col("tier").isin(*P.VERIFIED_TIERS)), "unqualified-evidence", 7, F.col("tier")))


def capability_missing(cards: DataFrame, capabilities: list[str]) -> DataFrame:
    bad = cards.filter((F.col("family") == "multiple-select") & F.lit(P.CAPABILITY["multiple-select"] not in capabilities))
    return _issue(bad, "capability-missing", 8, F.lit("the target cannot hold it"))


def validate(cards: DataFrame, ledger: DataFrame, capabilities: list[str], pairs: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """doc_id, card_id, code, message, rule_order: every issue, as export sees it; in_order() gives their order. pairs, items:
    those of matching cards, see matching_pairs."""
    cards = cards.filter("reject is null")
    options = cards.select("doc_id", "card_id", F.explode("options").alias("o")).select("doc_id", "card_id", "o.*")
    stems = cards.select("doc_id", F.concat(F.lit("ev_"), F.substring("source_id", 1, 16), F.lit("_stem")).alias("evidence_id"))
    found = dangling_evidence(stems.unionByName(options.select("doc_id", "evidence_id")), ledger)
    every = [duplicate_cards(cards), option_set_mismatch(cards), duplicate_options(options), family_rules(cards), unresolved_review(cards), evidence_tier(cards), capability_missing(cards, capabilities)]
    if pairs is not None and items is not None:
        every.append(matching_pairs(pairs, items))
    for issues in every:
        found = found.unionByName(issues)
    return found


#: Rules that go card by card in the order of the document; before them come those of the whole document, one after the other.
_BY_CARD = {3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3}


def in_order(issues: DataFrame, cards: DataFrame) -> DataFrame:
    """issues with block_no and issue_no, from 1 in each document: evidence, then equal ids, then the rules of each card in turn, then what
    only binds an export, again card by card. Issues of one rule and card are in the order of code and message. cards: doc_id,
    card_id, block_no; of cards with one id the first counts, and block_no is its own."""
    phase = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in _BY_CARD.items() for x in pair]), F.col("rule_order")), F.lit(0))
    # cards come among the issues, so that both are dealt out once, by document
    places = cards.filter("doc_id is not null and card_id is not null").select("doc_id", "card_id", "block_no")
    both = issues.withColumn("_issue", F.lit(True)).unionByName(places, allowMissingColumns=True).repartition("doc_id")
    rows = both.withColumn("block_no", F.min("block_no").over(Window.partitionBy("doc_id", "card_id"))).filter("_issue").withColumn("_phase", phase)
    rule_first = F.when(F.col("_phase") == 0, F.col("rule_order"))
    order = Window.partitionBy("doc_id").orderBy("_phase", rule_first, F.col("block_no").asc_nulls_first(), "rule_order", F.col("card_id").asc_nulls_first(), "code", "message")
    return rows.withColumn("issue_no", F.row_number().over(order)).drop("_phase", "_issue")


#: Codes that only warn; all others stop an export. None does so yet.
WARNINGS: tuple[str, ...] = ()


def issue_totals(issues: DataFrame) -> DataFrame:
    """doc_id, blocking and warnings: how many issues of either kind."""
    warns = F.col("code").isin(*WARNINGS) if WARNINGS else F.lit(False)
    return issues.groupBy("doc_id").agg(F.count_if(~warns).alias("blocking"), F.count_if(warns).alias("warnings"))


def card_mode(card: Column) -> Column:
    """The mode of a card given as JSON; a card with both markers, and any other, is unknown."""
    get = lambda k: F.get_json_object(card, f"$.{k}")
    kind = get("type")
    several, two = F.coalesce(get("selectionMode") == "multiple", F.lit(False)), F.coalesce(get("sourceFormat") == "true-false", F.lit(False))
    mode = F.when(kind.isin("flashcard", "typed", "matching", "image-occlusion"), kind).when(F.coalesce(kind != "mcq", F.lit(True)), "unknown")
    return mode.when(several & two, "unknown").when(several, "mcq-multiple").when(two, "mcq-true-false").otherwise("mcq-single")


def typed_promotion_safe(card: Column) -> Column:
    """One string to type: single-answer modes with an answer that is a string and not blank."""
    answer = F.get_json_object(card, "$.correctAnswer")
    is_string = F.coalesce(card.rlike(r'"correctAnswer"\s*:\s*"'), F.lit(False))
    return card_mode(card).isin("mcq-single", "mcq-true-false") & is_string & (F.trim(F.coalesce(answer, F.lit(""))) != "")
