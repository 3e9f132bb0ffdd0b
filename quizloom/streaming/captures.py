"""Capture streams: deduplication within a watermark, pairing with event-time timers, options joined across streams.

The material defines no lateness; WATERMARK is this engine's own default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

WATERMARK = "1 hour"
HOUR_MS = 60 * 60 * 1000

PAIR = "question_fingerprint string, question_id string, reveal_id string, status string, is_due boolean"
_FIELDS = ("question_at", "question_id", "reveal_at", "reveal_id", "keys", "unknown", "last_at", "due", "due_at", "ends_at")
_STATE = "question_at long, question_id string, reveal_at long, reveal_id string, keys string, unknown boolean, last_at long, due boolean, due_at long, ends_at long"


def deduplicated(captures: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One capture for each state fingerprint; rerenders that come within the watermark collapse."""
    return captures.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["state_fingerprint"])


class Pairing(StatefulProcessor):
    """The state of one question fingerprint; all times are event times in milliseconds.

    What a question is follows from the times of its captures, not from the order they come in: of questions and of reveals the
    earliest counts, a reveal counts if it comes within `wait` of the question, and a question without one is overdue when a
    capture or the watermark is past that time. State lives until `keep` has passed without a capture; what comes then begins
    anew. So a log that is replayed in other batches ends in the same states, if its captures are out of order by less than the
    watermark and not across such a silence.
    """

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _load(self) -> dict:
        held = self.seen.get() if self.seen.exists() else (None, None, None, None, "", False, None, False, None, None)
        return dict(zip(_FIELDS, held, strict=True))

    def _row(self, key: tuple, s: dict, is_due: bool) -> pd.DataFrame:
        question, reveal = s["question_id"], s["reveal_id"]
        late = question and reveal and s["reveal_at"] > s["question_at"] + self.wait_ms
        overdue = question and not reveal and (s["due"] or s["last_at"] > s["question_at"] + self.wait_ms)
        if late or overdue or "\n" in s["keys"] or (s["unknown"] and not reveal):
            status = "NeedsReview"
        else:
            status = "AwaitingEvidence" if not reveal else "DraftReady" if question else "RevealCaptured"
        return pd.DataFrame({"question_fingerprint": [key[0]], "question_id": [question], "reveal_id": [reveal], "status": [status], "is_due": [is_due]})

    def _move_timer(self, s: dict, name: str, at: int | None) -> None:
        if s[name] != at:
            if s[name] is not None:
                self.handle.deleteTimer(s[name])
            if at is not None:
                self.handle.registerTimer(at)
            s[name] = at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        s = self._load()
        for r in pd.concat(list(rows)).sort_values(["at", "capture_id"]).itertuples():
            if s["last_at"] is not None and r.at > s["last_at"] + self.keep_ms:
                s |= dict.fromkeys(("question_at", "question_id", "reveal_at", "reveal_id")) | {"keys": "", "unknown": False, "due": False}
            if r.state in ("question", "reveal"):
                at, name = f"{r.state}_at", f"{r.state}_id"
                if s[at] is None or (r.at, r.capture_id) < (s[at], s[name]):
                    s[at], s[name] = int(r.at), r.capture_id
            if r.state == "reveal":
                s["keys"] = "\n".join(sorted({*filter(None, s["keys"].split("\n")), r.answer_key}))
            s["unknown"] = s["unknown"] or r.state not in ("question", "reveal")
            s["last_at"] = max(int(r.at), s["last_at"] or 0)
        self._move_timer(s, "due_at", s["question_at"] + self.wait_ms if s["question_id"] and not s["reveal_id"] and not s["due"] else None)
        self._move_timer(s, "ends_at", s["last_at"] + self.keep_ms)
        self.seen.update(tuple(s[f] for f in _FIELDS))
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        s, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if s["due_at"] == at:
            s |= {"due": True, "due_at": None}
            self.seen.update(tuple(s[f] for f in _FIELDS))
            yield self._row(key, s, True)
        if s["ends_at"] == at:
            self.seen.clear()

    def close(self) -> None:
        pass


def paired(captures: DataFrame, watermark: str = WATERMARK, wait_ms: int = HOUR_MS, keep_ms: int = 24 * HOUR_MS) -> DataFrame:
    """The status of each question after every batch that touches it, and once more (is_due) when its reveal is overdue: update
    mode. The latest row of a key, of one batch the one that is due, is its state.

    Needs the state store of RocksDB (`spark.sql.streaming.stateStore.providerClass`).
    """
    at = F.unix_millis("event_time").alias("at")
    rows = captures.withWatermark("event_time", watermark).select("question_fingerprint", "capture_id", "state", F.coalesce("answer_key", F.lit("?")).alias("answer_key"), at, "event_time")
    return rows.groupBy("question_fingerprint").transformWithStateInPandas(Pairing(wait_ms, keep_ms), PAIR, "Update", "EventTime")


def resolved_options(question: DataFrame, reveal: DataFrame, watermark: str = WATERMARK, within: str = "1 hour") -> DataFrame:
    """captures.resolved_options() over streams: options of question states (question_fingerprint, clean_text, event_time) with
    what the reveal (is_correct too) states for the same text within `within` of the question, before or after.

    Options without a reveal come, with a null, when the watermark has passed their range; state is kept no longer than that.
    An option that several reveals state comes with each. Rows later than the watermark are dropped: late_rows() counts them.
    """
    q = question.select("question_fingerprint", "clean_text", F.col("event_time").alias("question_time")).withWatermark("question_time", watermark)
    r = reveal.select(F.col("question_fingerprint").alias("_fingerprint"), F.col("clean_text").alias("_text"), "is_correct", F.col("event_time").alias("reveal_time")).withWatermark("reveal_time", watermark)
    span = F.expr(f"reveal_time BETWEEN question_time - INTERVAL {within} AND question_time + INTERVAL {within}")
    joined = q.join(r, (F.col("question_fingerprint") == F.col("_fingerprint")) & (F.col("clean_text") == F.col("_text")) & span, "leftOuter")
    return joined.select("question_fingerprint", "clean_text", "question_time", "is_correct")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream has dropped as later than its watermark, over the progress that is still held."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def counts(captures: DataFrame, watermark: str = WATERMARK, width: str = "10 minutes") -> DataFrame:
    """Captures by state and event-time window; late ones within the watermark count."""
    return captures.withWatermark("event_time", watermark).groupBy(F.window("event_time", width), "state").agg(F.count(F.lit(1)).alias("n"))
