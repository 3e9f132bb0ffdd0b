"""Operator 8: token ids as Parquet list columns.

Ids are dictionary-coded (at most a vocabulary of entries for each row group), document ids and positions delta-coded;
rows are in ascending doc_id order, row groups and pages are bounded, and the page index lets a reader of a few documents,
or of the lengths alone, skip the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, id_text, list_array, shared_dir
from quizloom.llm.tokens import TOKENIZER, crc, encode_column

#: doc_id; part and start_in_part: the range it was written with, and the ids before it there; n_tokens; ids.
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode every document (null text: empty), each with the end id 0 after it, and write the files.

    Equal doc_ids stay together, ordered by text; a null doc_id comes first. Empty input gives files without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in blocks(batches):
            coded = encode_column(tokenizer, batch.column("text"))
            size = np.array([len(x) // 4 for x in coded], dtype=np.int64)
            ends = np.cumsum(size)
            ids = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            columns = [batch.column("doc_id"), pa.array(np.full(len(size), part, np.int32)), pa.array(start + ends - size), pa.array(size), list_array(np.concatenate([[0], ends]), ids)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += int(ends[-1])

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encode, SCHEMA).write.option("compression", "snappy")
    settings = {
        "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#start_in_part": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    for k, v in settings.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the ids are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "start_in_part", "n_tokens")
    return rows.join(F.broadcast(_part_starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with their ids; `first` and `last` bound doc_id, and reach the row groups and pages by their statistics."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def _part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part: one row for each range that was written, so as many as files."""
    sums = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids as they are in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.values.to_numpy().astype("<i4", copy=False)[at[0] : at[-1]].view(np.uint8)) if len(ids) else memoryview(b"")
            ends = (4 * (at - at[0])).tolist()
            found = [crc(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(at)), pa.array(found, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "start_in_part", "ids")
    found = rows.mapInArrow(read, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(_part_starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), path)
    return digests(spark, path)
