"""Recognisers, and the ladder of their passes. A recogniser is any function from the bytes of an image; none comes with the library.

A pass that fails is a row with its error: one image that cannot be read must not lose the others, and is not lost itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions.tables import materialized
from quizloom.operators import geometry, segments
from quizloom.sources.images import image_rows, portable_pixels
from quizloom.sources.readers import WORDS

__all__ = ["LADDER", "attempt", "image_rows", "ladder", "parses", "portable_pixels", "recognised"]

#: page, block, paragraph, line, word (numbers), left, top, width, height, confidence, text.
Word = tuple[int, int, int, int, int, int, int, int, int, float, str]
# The modes of page segmentation in the order they are tried, and seconds that a call may take.
LADDER = (3, 6, 4)
SECONDS = 600.0
#: Images that one task hands to Python at a time are read in batches of Arrow; errors keep so many characters.
MOST_ERROR = 300

_NAMES = ["doc_id", "level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
_KINDS = [pa.int64(), *[pa.int32()] * 10, pa.float64(), pa.string()]


def _called(calls: Iterable[Callable[[], object]], seconds: float) -> Iterator[tuple[object, str | None]]:
    """What each call gives, or how it failed. One that takes too long is given up (its thread ends with it) and the next has a
    thread of its own; otherwise the calls share one."""
    pool = ThreadPoolExecutor(1)
    try:
        for call in calls:
            try:
                done = pool.submit(call).result(timeout=seconds), None
            except Late:
                done = None, f"took over {seconds:g} seconds"
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(1)
            except Exception as e:  # noqa: BLE001 - the recogniser is foreign code
                done = None, f"{type(e).__name__}: {e}"[:MOST_ERROR]
            yield done
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def recognised(images: DataFrame, recogniser: Callable[[bytes], Iterable[Word]], seconds: float = SECONDS) -> DataFrame:
    """A word table of images (doc_id, content) with `error`; an image that the recogniser fails on is one row without words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calls = (lambda c=c: [*recogniser(c or b"")] for c in batch.column("content").to_pylist())
            for doc, (words, error) in zip(batch.column("doc_id").to_pylist(), _called(calls, seconds), strict=True):
                rows = [(doc, *[None] * 12, error)] if error else [(doc, 5, *w, None) for w in words]
                columns = zip(*rows, strict=True) if rows else [[]] * 14
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*_KINDS, pa.string()], strict=True)], names=[*_NAMES, "error"])

    return images.select(F.col("doc_id").cast("long"), "content").mapInArrow(read, f"doc_id long, {WORDS}, error string")


def attempt(images: DataFrame, recogniser: Callable[[bytes, int], str], mode: int, seconds: float = SECONDS) -> DataFrame:
    """doc_id, text and error of one pass over images (doc_id, content): the text is empty where the call fails."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [*_called((lambda c=c: recogniser(c or b"", mode) for c in batch.column("content").to_pylist()), seconds)]
            texts = [t if isinstance(t, str) else "" for t, _ in done]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([e for _, e in done], pa.string())], names=["doc_id", "text", "error"])

    return images.select(F.col("doc_id").cast("long"), "content").mapInArrow(read, "doc_id long, text string, error string")


def parses(texts: DataFrame) -> DataFrame:
    """doc_id of texts (doc_id, text) in which the segmentation finds a question with two options at least."""
    lines = materialized(segments.lines(texts, "text"), "lines")
    found = segments.blocks(segments.placed_lines(lines, segments.answer_key(lines)))
    return geometry.usable_blocks(found).filter("usable > 0").select("doc_id")


def ladder(images: DataFrame, recogniser: Callable[[bytes, int], str], accept: Callable[[DataFrame], DataFrame] = parses, modes: tuple[int, ...] = LADDER, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """The kept text of each image (doc_id, psm, text, n_calls, n_errors), and the log of all passes (doc_id, attempt, psm,
    text, error, accepted).

    accept gives the doc_ids whose text will do. The passes run one after the other, each over the images that none before it
    has settled: what is accepted is never read again. Without an accepted pass the wordiest stays, the earlier of equals.
    Each pass is written once, as accept and the next pass both read it. doc_id must tell images apart; null ones are left out.
    """
    pending, log = images.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "content"), None
    for number, mode in enumerate(modes, start=1):
        read = materialized(attempt(pending, recogniser, mode, seconds), "pass")
        settled = materialized(accept(read.filter("error is null").select("doc_id", "text")).select("doc_id").distinct(), "accepted")
        rows = read.join(settled.withColumn("accepted", F.lit(True)), "doc_id", "left").select("doc_id", F.lit(number).alias("attempt"), F.lit(mode).alias("psm"), "text", "error", F.coalesce("accepted", F.lit(False)).alias("accepted"))
        log = rows if log is None else log.unionByName(rows)
        pending = pending.join(settled, "doc_id", "left_anti")
    counts = log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count("error").alias("n_errors"))
    return geometry.best_pass(log).join(counts, "doc_id"), log
