"""Pages that were read as images: each is taken as lettered text or as a drawn page, whichever gives more usable blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions.tables import materialized
from quizloom.operators import cards as C
from quizloom.operators import geometry, segments


def page_blocks(words: DataFrame, texts: DataFrame, rows: DataFrame | None = None, readings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """blocks (with `reading`: text or drawn) and the answer key of pages. words: a word table; texts: doc_id and body, the
    text of the recognition pass that was kept; rows, readings: see geometry.drawn_blocks. A tie is for the text; a drawn page
    has no key, its answers are marks."""
    parsed = materialized(segments.lines(texts), "lines")
    key = materialized(segments.answer_key(parsed), "keys")
    both = [segments.blocks(segments.placed_lines(parsed, key)).withColumn("reading", F.lit("text")), geometry.drawn_blocks(words, rows, readings).withColumn("reading", F.lit("drawn"))]
    found = materialized(both[0].unionByName(both[1]), "blocks")
    counts = [geometry.usable_blocks(found.filter(F.col("reading") == r)).withColumn("reading", F.lit(r)) for r in ("text", "drawn")]
    chosen = geometry.choose_reading(counts[0].unionByName(counts[1])).select("doc_id", "reading")
    return found.join(chosen, ["doc_id", "reading"]), key.join(chosen.filter("reading = 'text'").select("doc_id"), "doc_id", "left_semi")


def page_cards(words: DataFrame, texts: DataFrame, rows: DataFrame | None = None, readings: DataFrame | None = None) -> DataFrame:
    """Cards of pages, as of texts: what happens after the blocks are known is the same."""
    blocks, key = page_blocks(words, texts, rows, readings)
    return C.cards(C.resolved(blocks, key), texts, True)
