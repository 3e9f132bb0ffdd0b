"""The flagship plan: documents of quiz text to cards, decks and everything refused, with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions.tables import dealt, materialized
from quizloom.functions.text import needs_python
from quizloom.operators import cards as C
from quizloom.operators import rules, segments
from quizloom.plans import export

ALL_CAPABILITIES = ["mcq.single", "mcq.multiple-select.v1", "mcq.true-false", "flashcard"]


@dataclass
class TextResult:
    blocks: DataFrame
    cards: DataFrame
    unsupported: DataFrame
    ledger: DataFrame
    issues: DataFrame
    decks: DataFrame
    blocked: DataFrame
    drafts: DataFrame


def text_cards(docs: DataFrame, body: str = "body", by_position: bool = True, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """blocks and cards of documents (doc_id, body). Texts that need entities decoded or accents composed take a path with
    an Arrow UDF; the rest, the bulk of a corpus, stays in the JVM.

    Documents, lines and blocks are dealt out by document, in as many tasks at every size, and each step groups them where they are. once: the cards are read a single time, so
    they are not written, and what that reader does not ask for is not computed.
    """
    docs = dealt(docs.select("doc_id", body, *[c for c in C.DEFAULTS if c in docs.columns]), "doc_id")
    parsed = dealt(materialized(segments.lines(docs, body), "lines"), "doc_id")
    key = dealt(materialized(segments.answer_key(parsed), "keys"), "doc_id")
    blocks = segments.blocks(segments.placed_lines(parsed, key))
    told = C.with_defaults(docs).select("doc_id", F.coalesce(needs_python(F.col(body)), F.lit(False)).alias("_python"), *C.DEFAULTS)
    resolved = C.resolved(blocks.withColumn("_inline", F.col("inline_letters")), key)
    # the blocks are read twice, by each way of cleaning texts, and few bytes of them are much work
    held = materialized(resolved.join(told.hint("shuffle_hash"), "doc_id", "left"), "blocks")
    marked = dealt(held.drop("_inline"), "doc_id")
    plain = C.cards(marked.filter("not _python").drop("_python"), docs, False, by_position)
    other = C.cards(marked.filter("_python").drop("_python"), docs, True, by_position)
    cards = plain.unionByName(other)
    return held.withColumnRenamed("_inline", "inline_letters").select(*blocks.columns), cards if once else materialized(cards, "cards")


def process_text(docs: DataFrame, capabilities: list[str] | None = None, body: str = "body") -> TextResult:
    """Validation does not gate export: both always run, and export has its own gates."""
    capabilities = ALL_CAPABILITIES if capabilities is None else capabilities
    if "title" not in docs.columns:
        docs = docs.withColumn("title", F.lit("captured"))
    blocks, cards = text_cards(docs, body)
    ledger = C.evidence(cards)
    return TextResult(
        blocks, cards, C.unsupported(cards), ledger, rules.validate(cards, ledger, capabilities),
        export.decks(cards, docs, capabilities), export.blocked(cards, capabilities), export.drafts(cards),
    )
