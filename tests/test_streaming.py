"""Streams end in the state that the batch operators give, however a log is cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from quizloom.operators import captures as batch
from quizloom.operators import jobs
from quizloom.streaming import captures as stream
from quizloom.streaming import facts

ROWS = [
    ("c1", "2024-01-01 00:00:00", "q1", "q1:q", "question", None), ("c2", "2024-01-01 00:00:01", "q1", "q1:q", "question", None), ("c3", "2024-01-01 00:01:00", "q1", "q1:r", "reveal", "A"),
    ("c4", "2024-01-01 00:02:00", "q2", "q2:q", "question", None), ("c5", "2024-01-01 00:03:00", "q3", "q3:r", "reveal", "A"), ("c6", "2024-01-01 00:04:00", "q3", "q3:r2", "reveal", "B"), ("c7", "2024-01-01 00:05:00", "q4", "q4:r", "reveal", "A"),
]
CAPTURE = "capture_id string, created_at string, question_fingerprint string, state_fingerprint string, state string, answer_key string"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def replayed(spark, rows, schema, path, sizes):
    """rows as a stream with files of the given sizes, a batch for each."""
    at = 0
    for k, size in enumerate(sizes):
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
        at += size
    assert at == len(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path).withColumn("event_time", F.to_timestamp("created_at"))


def latest(rows):
    return {r["question_fingerprint"]: tuple(r["s"]) for r in rows.groupBy("question_fingerprint").agg(F.max_by(F.struct("question_id", "reveal_id", "status"), F.struct("_batch", "is_due")).alias("s")).collect()}


def test_pairing_and_deduplication(spark, tmp_path, rocksdb):
    rows = spark.createDataFrame(ROWS, CAPTURE)
    events = replayed(spark, ROWS, CAPTURE, f"{tmp_path}/in", [4, 3])
    pairs, _ = facts.drained(stream.paired(events), "pairs", "update")
    got = {k: v[2] for k, v in latest(pairs).items()}
    assert got == {r["question_fingerprint"]: r["status"] for r in batch.paired(rows).collect()} == {"q1": "DraftReady", "q2": "AwaitingEvidence", "q3": "NeedsReview", "q4": "RevealCaptured"}
    dedup, _ = facts.drained(stream.deduplicated(events), "dedup")
    assert {r["state_fingerprint"] for r in dedup.collect()} == {r["state_fingerprint"] for r in batch.deduplicated(rows).collect()}
    counts, _ = facts.drained(stream.counts(events), "counts", "update")
    assert counts.agg(F.sum("n")).first()[0] >= len(ROWS)


def at(minute):
    return f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00"


def test_replay_in_any_batching(spark, tmp_path, rocksdb):
    """One log, in order of time, in one batch, in many and in odd ones: the same states, overdue and forgotten ones too."""
    rng = random.Random(5)
    log, minute = [], 0
    for k in range(120):
        minute += rng.choice([1, 3, 10, 40, 90, 400])
        log.append((f"c{k:03d}", at(minute), f"q{rng.randint(1, 6)}", f"s{k}", rng.choice(["question", "question", "reveal", "unknown"]), rng.choice("AB")))
    ends = []
    for n, sizes in enumerate(([120], [40, 40, 40], [7] * 17 + [1])):
        events = replayed(spark, log, CAPTURE, f"{tmp_path}/in{n}", sizes)
        pairs, _ = facts.drained(stream.paired(events, keep_ms=4 * stream.HOUR_MS), "pairs", "update")
        ends.append(latest(pairs))
    assert ends[0] == ends[1] == ends[2] and {s for _, _, s in ends[0].values()} >= {"NeedsReview"}


def test_due_when_the_watermark_passes(spark, tmp_path, rocksdb):
    """A question without a reveal needs review once its time is over, by other captures' times alone; one that is disordered
    within the watermark still counts, and a reveal that is too late does not make a draft."""
    log = [("a", at(0), "q1", "s1", "question", None), ("b", at(5), "q2", "s2", "question", None), ("r", at(3), "q2", "s3", "reveal", "A"), ("c", at(300), "q3", "s4", "question", None), ("e", at(301), "q3", "s7", "question", None), ("l", at(290), "q1", "s5", "reveal", "A"), ("d", at(310), "q3", "s6", "reveal", "B")]
    pairs, _ = facts.drained(stream.paired(replayed(spark, log, CAPTURE, f"{tmp_path}/in", [2, 1, 1, 1, 2])), "pairs", "update")
    seen = [(r["question_fingerprint"], r["status"], r["is_due"]) for r in pairs.orderBy("_batch", "is_due").collect()]
    assert ("q1", "AwaitingEvidence", False) in seen and ("q1", "NeedsReview", True) in seen and ("q2", "NeedsReview", True) not in seen
    assert {k: v[2] for k, v in latest(pairs).items()} == {"q1": "NeedsReview", "q2": "DraftReady", "q3": "DraftReady"}


def test_options_joined_as_streams(spark, tmp_path):
    """Rows as the batch join gives them; unanswered ones come when they can no longer be answered; later ones are counted."""
    schema = "created_at string, kind string, question_fingerprint string, clean_text string, is_correct boolean"
    log = [(at(0), "question", "q1", "x", None), (at(0), "question", "q1", "y", None), (at(20), "reveal", "q1", "y", True), (at(20), "reveal", "q1", "x", False), (at(30), "question", "q2", "z", None), (at(600), "question", "q9", "w", None), (at(600), "reveal", "q9", "w", True)]
    late = [(at(610), "question", "q7", "u", None), (at(610), "reveal", "q7", "u", False), (at(31), "reveal", "q2", "z", True), (at(900), "question", "q8", "v", None), (at(900), "reveal", "q8", "v", True)]
    events = replayed(spark, log + late, schema, f"{tmp_path}/in", [4, 3, 2, 1, 2])
    found, query = facts.drained(stream.resolved_options(events.filter("kind = 'question'"), events.filter("kind = 'reveal'")), "options")
    got = {(r["question_fingerprint"], r["clean_text"]): r["is_correct"] for r in found.collect()}
    rows = spark.createDataFrame([r for r in log + late if r[0] != at(31)], schema)
    want = batch.resolved_options(rows.filter("kind = 'question'").drop("is_correct"), rows.filter("kind = 'reveal'"))
    assert got == {(r["question_fingerprint"], r["clean_text"]): r["is_correct"] for r in want.collect()}
    assert stream.late_rows(query) == 1 and got["q2", "z"] is None


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    """Also after a crash between its two writes, and with events that are sent again in a later batch."""
    rng = random.Random(2)
    events = [(k, rng.randint(1, 9), rng.choice(["queued", "running", "failed"]), f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}") for k in range(200)]
    schema = "event_id long, entity_id long, state string, at string"
    df = lambda rows: spark.createDataFrame(rows, schema).select("event_id", "entity_id", "state", F.to_timestamp("at").alias("occurred_at"))
    table = facts.StateTable(spark, f"{tmp_path}/table", buckets=3)
    assert table.states().collect() == []
    key = lambda d: sorted(map(tuple, d.select("entity_id", "state", "n_events").collect()))
    table(df(events[:80]), 0)
    table(df(events[:80]), 0)
    assert key(table.states()) == key(jobs.states(df(events[:80])))
    table(df(events[60:150]), 1)
    (tmp_path / "table" / "states" / "batch=1" / "_SUCCESS").unlink()  # as if the job had died before it
    assert key(table.states()) == key(jobs.states(df(events[:80])))
    table(df(events[60:150]), 1)
    table(df(events[60:150]), 1)
    table(df(events[140:]), 2)
    table(df(events[:0]), 3)
    assert key(table.states()) == key(jobs.states(df(events))) and table.versions() == [2, 3]


def test_reveal_marks_the_text_not_the_place(spark):
    question = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "question_fingerprint string, clean_text string, pos int")
    reveal = spark.createDataFrame([("q", "b", True), ("q", "a", False)], "question_fingerprint string, clean_text string, is_correct boolean")
    assert {r["clean_text"]: r["is_correct"] for r in batch.resolved_options(question, reveal).collect()} == {"a": False, "b": True}
