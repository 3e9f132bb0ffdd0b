"""Operator 1: packing token pieces into windows by minimum bin slack.

Documents are cut after each full window; what remains is a piece of 1 to capacity - 1 tokens. Only lengths matter to the
plan, so it is made from their histogram, which has at most `capacity` entries whatever the corpus holds. The plan is a
list of patterns (a multiset of lengths, and how many windows are filled with it); every piece then finds its place from
its length and its rank among pieces of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, id_text, stored
from quizloom.llm.tokens import TOKENIZER, crc, encode_column

CAPACITY = 1024
#: Ranks of one length are counted in so many parts, so that no task gets all pieces of a frequent length.
RANK_PARTS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every document: `capacity` ids each, the last what remains. Needs doc_id and text; null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_column(tokenizer, batch.column("text")), strict=True):
                view, n = memoryview(ids), len(ids) // 4
                for at in range(0, n, capacity):
                    to = min(n, at + capacity)
                    rows.append((doc, at, to - at, crc(view[4 * at : 4 * to]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs).mapInArrow(cut, PIECES)


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of available lengths whose sum is largest within `room`: bit s of the set says that s can be reached."""
    reached, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before, left, step = reached, min(counts[length], room // length), 1
        while left:  # 1, 2, 4 ... copies and the rest: every number of copies up to `left`
            take = min(step, left)
            reached |= (reached << (take * length)) & limit
            left -= take
            step *= 2
        steps.append((length, before))
        if reached >> room & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            used[length] = copies
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns and how many windows take each, until no piece is left. The longest piece left is always in the next
    window; a pattern is repeated as long as the counts allow, so there are few more patterns than lengths."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fill(capacity - longest, {k: v for k, v in rest.items() if v})
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((times, pattern))
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def _ranked(pieces: DataFrame) -> DataFrame:
    """`rank`: the number of pieces of the same length before this one, counted in parts."""
    parts = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_PARTS)))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    sizes = parts.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("_length"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = parts.withColumn("_row", F.row_number().over(own))
    joined = ranked.join(base, (ranked["length"] == base["_length"]) & (ranked["_part"] == base["_of"]))
    return joined.withColumn("rank", F.col("_base") + F.col("_row") - 1)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, doc_tokens).

    Pieces are read several times: give a stored table. No pieces: no rows. Repeated rows are packed one by one.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(histogram, 0)
    sequence = 0
    for times, pattern in plan_windows(histogram, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            ranges.setdefault(length, []).append((taken[length], pattern[length], sequence, offset))
            taken[length] += times * pattern[length]
            offset += length * pattern[length]
        sequence += times
    table = {k: np.array(v, dtype=np.int64).T for k, v in ranges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence_id, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                first, uses, base, shift = table[int(size)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                n = rank[own] - first[k]
                sequence_id[own] = base[k] + n // uses[k]
                offset[own] = shift[k] + n % uses[k] * size
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence_id), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = _ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack whole documents; columns as pack() returns them. Null or empty text: the end id alone. Null doc_id: kept."""
    return pack(stored(cut_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
