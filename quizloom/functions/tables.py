"""Intermediate tables: what several later steps read is written once, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one beside the warehouse, on a machine that runs all of Spark."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/_work"
    return at.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys into three tasks for each core, whatever its bytes: where much work is made of small rows, Spark would
    put them together into too few, and many more tasks cost more than they even out, as each unpacks a large plan. What follows
    is grouped by these keys without being moved again."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys, at = batch.column(key).to_pylist(), 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[at]:
                continue
            if held and keys[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, k - at))
            last, at = keys[at], k
    if held:
        yield pa.Table.from_batches(held)
