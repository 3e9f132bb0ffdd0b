"""Captures of question and reveal states: deduplication, pairing, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(captures: DataFrame) -> DataFrame:
    """The earliest capture of each state; equal times are settled by id."""
    order = Window.partitionBy("state_fingerprint").orderBy("created_at", "capture_id")
    return captures.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def paired(captures: DataFrame) -> DataFrame:
    """question_fingerprint, question_id, reveal_id and status. Only reveal states give answers; what a user has picked in a
    question state does not. A question without a reveal awaits it; reveals that disagree, and unknown states, need review."""
    rows = captures.groupBy("question_fingerprint").agg(
        F.min_by(F.when(F.col("state") == "question", F.col("capture_id")), F.when(F.col("state") == "question", F.struct("created_at", "capture_id"))).alias("question_id"),
        F.min_by(F.when(F.col("state") == "reveal", F.col("capture_id")), F.when(F.col("state") == "reveal", F.struct("created_at", "capture_id"))).alias("reveal_id"),
        F.count_distinct(F.when(F.col("state") == "reveal", F.col("answer_key"))).alias("n_keys"),
        F.max((F.col("state") == "unknown").cast("int")).alias("unknown"),
    )
    status = F.when((F.col("n_keys") > 1) | ((F.col("unknown") == 1) & F.col("reveal_id").isNull()), "NeedsReview").when(F.col("reveal_id").isNull(), "AwaitingEvidence")
    return rows.select("question_fingerprint", "question_id", "reveal_id", "n_keys", status.when(F.col("question_id").isNull(), "RevealCaptured").otherwise("DraftReady").alias("status"))


def contradictions(captures: DataFrame) -> DataFrame:
    """Questions whose reveals state different answers."""
    keys = captures.filter("state = 'reveal'").groupBy("question_fingerprint").agg(F.count_distinct("answer_key").alias("n_keys"))
    return keys.filter("n_keys > 1")


def resolved_options(question: DataFrame, reveal: DataFrame) -> DataFrame:
    """Options of question states with the correctness that the reveal gives the same clean text, wherever it stands.
    Both: question_fingerprint, clean_text; reveal: is_correct too."""
    told = reveal.groupBy("question_fingerprint", "clean_text").agg(F.bool_or("is_correct").alias("is_correct"))
    return question.join(told, ["question_fingerprint", "clean_text"], "left")
