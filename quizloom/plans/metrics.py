"""How well cards agree with what was expected of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import patterns as P
from quizloom.functions.text import collapse


def golden(expected: DataFrame, found: DataFrame) -> DataFrame:
    """metric and value over all expected cards. expected and found: doc_id, block_no, family, question, options (array of
    text, is_correct) and tier; expected: known (does the material state the answer).

    question_exact, options_exact: normalised texts in order; family_accuracy; correct_set_accuracy: of cards whose answer is
    known; false_authoritative: cards found as verified with another set than that expected, or with an answer that is not
    known; blocked_when_unknown: unknown answers that are not verified; tier_accuracy. A card that is not found counts as
    wrong, but is not authoritative.
    """
    right = lambda c: F.array_sort(F.transform(F.filter(c, lambda o: o["is_correct"]), lambda o: collapse(o["text"])))
    texts = lambda c: F.transform(c, lambda o: collapse(o["text"]))
    keys = ["doc_id", "block_no"]
    e = expected.select(*keys, "known", *[F.col(c).alias(f"e_{c}") for c in ("family", "question", "options", "tier")])
    f = found.select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("family", "question", "options", "tier")])
    rows = e.join(f, keys, "left")
    same = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    sets = right(F.col("e_options")) == right(F.col("f_options"))
    verified = F.coalesce(F.col("f_tier").isin(*P.VERIFIED_TIERS), F.lit(False))
    known = F.col("known")
    share = lambda test, of: F.avg(F.when(of, F.coalesce(test, F.lit(False)).cast("double")))
    values: dict[str, Column] = {
        "question_exact": same(collapse(F.col("e_question")) == collapse(F.col("f_question"))),
        "options_exact": same(texts(F.col("e_options")) == texts(F.col("f_options"))),
        "family_accuracy": same(F.col("e_family") == F.col("f_family")),
        "correct_set_accuracy": share(sets, known),
        "false_authoritative": same(verified & ~(known & F.coalesce(sets, F.lit(False)))),
        "blocked_when_unknown": share(~verified, ~known),
        "tier_accuracy": same(F.col("e_tier") == F.col("f_tier")),
    }
    one = rows.agg(*[v.alias(k) for k, v in values.items()])
    return one.unpivot([], list(values), "metric", "value")


def matched(expected: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, e_block and f_block: which found card is which expected one, each at most once (doc_id, block_no, question).

    Cards whose normalised questions are equal go together first, in turn if there are several; of the others, those whose words
    overlap the most (shared over all, `least` at least), the earlier of equals. So cards that are shifted, or split in two, are
    still told. Pairs are made from shared words within a document, and chosen in one pass over them in order: a task holds the numbers of one
    document's cards.
    """
    numbered = lambda rows, side: rows.select("doc_id", F.col("block_no").alias(f"{side}_block"), collapse(F.col("question")).alias("question")).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "question").orderBy(f"{side}_block")))
    e, f = numbered(expected, "e"), numbered(found, "f")
    equal = e.join(f, ["doc_id", "question", "k"]).select("doc_id", "e_block", "f_block")
    words = F.array_distinct(F.filter(F.split(F.lower("question"), " "), lambda w: w != ""))
    left = lambda rows, side: rows.join(equal, ["doc_id", f"{side}_block"], "left_anti").select("doc_id", f"{side}_block", words.alias(f"{side}_words"))
    spread = lambda rows, side: rows.select("doc_id", f"{side}_block", F.size(f"{side}_words").alias(f"{side}_size"), F.explode(f"{side}_words").alias("word"))
    shared = spread(left(e, "e"), "e").join(spread(left(f, "f"), "f"), ["doc_id", "word"]).groupBy("doc_id", "e_block", "f_block", "e_size", "f_size").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("n") / (F.col("e_size") + F.col("f_size") - F.col("n"))
    kind = f"doc_id {expected.schema['doc_id'].dataType.simpleString()}, e_block {expected.schema['block_no'].dataType.simpleString()}, f_block {found.schema['block_no'].dataType.simpleString()}"

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs in turn, whose cards are both free still; those of a document come together, the best first."""
        doc, taken_e, taken_f = None, set(), set()
        for batch in batches:
            keep = []
            for d, e_block, f_block in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "e_block", "f_block")], strict=True):
                if d != doc:
                    doc, taken_e, taken_f = d, set(), set()
                free = e_block not in taken_e and f_block not in taken_f
                keep.append(free)
                if free:
                    taken_e.add(e_block)
                    taken_f.add(f_block)
            yield batch.filter(pa.array(keep, pa.bool_()))

    pairs = shared.withColumn("score", score).filter(F.col("score") >= least).repartition("doc_id").sortWithinPartitions("doc_id", F.desc("score"), "e_block", "f_block")
    near = pairs.select("doc_id", "e_block", "f_block").mapInArrow(chosen, kind)
    return equal.unionByName(near)


def detection(expected: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """metric (detection_precision, detection_recall) and value: of the found cards those that are expected ones, and of the
    expected cards those that are found; null where there are none."""
    counts = {"both": matched(expected, found, least), "f": found, "e": expected}
    rows = [df.select(F.lit(name).alias("of"), F.lit(1).alias("one")) for name, df in counts.items()]
    one = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.count_if(F.col("of") == name).alias(name) for name in counts])
    return one.select(F.try_divide("both", "f").alias("detection_precision"), F.try_divide("both", "e").alias("detection_recall")).unpivot([], ["detection_precision", "detection_recall"], "metric", "value")


def aligned(expected: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """found with the block_no of the expected card that each is; cards that are none are left out, so that golden() compares
    cards by what they say and not by where they stand."""
    pairs = matched(expected, found, least).withColumnRenamed("f_block", "block_no")
    return found.join(pairs, ["doc_id", "block_no"]).drop("block_no").withColumnRenamed("e_block", "block_no")
