"""Helpers shared by the training-data operators: Arrow blocks, word hashes, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/_work"
    return at.rstrip("/")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k.replace("__", "."), v)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets of its rows; nulls are empty."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64; n of each at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(int(_P), -1, 1 << 64)
        for k, base in (("up", _P), ("down", np.uint64(inverse))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    start, end: byte positions in `data`; first: the n + 1 word offsets of the rows; hash: a 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, at = raw_bytes(column)
        self.data, self.at = (_LOWER[data] if lower else data), at
        n = len(data)
        inside = _WORD[data]
        cuts = at[:-1][at[:-1] < n]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = at[1:][at[1:] > 0] - 1
        stops[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self._hash = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = powers(len(self.data) + 1)
            s = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=s[1:])
            self._hash = mix((s[self.end] - s[self.start]) * down[self.start])
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k-word sequences inside one row, the word each starts at, and the rows' n + 1 offsets."""
        h, n = self.hash, np.maximum(self.count - k + 1, 0)
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
        m = len(h) - k + 1
        g = h[:m].copy()
        for j in range(1, k):
            g *= _Q
            g += h[j : j + m]
        offsets = np.concatenate([[0], np.cumsum(n)])
        pick = np.repeat(self.first[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
        return mix(g[pick]), pick, offsets


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: row k holds the bytes of values[bounds[k]:bounds[k + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8))])


def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of all rows of a packed column, one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=kind)


def group_bounds(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the n + 1 bounds of their runs."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(1, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[cut], np.concatenate([cut, [len(sorted_keys)]])


def group_count(size: int, each: int, least: int = 61) -> int:
    """How many groups hold about `each` of `size` (bytes)."""
    return max(least, -(-size // each))


#: Stands for a null doc_id inside an operator.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, groups: int) -> DataFrame:
    """id_text with `place`, a hash of doc_id and text, and the group `of` that it falls into."""
    rows = id_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text"))
    return rows.withColumn("of", F.pmod("place", F.lit(groups)).cast("int"))


def with_null_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


#: A key with over a HOT-th of all rows (and over LEAST_HOT) does not go through the shuffle.
HOT = 1000
LEAST_HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left joined with right, a stored table of one row for each key, whose `_n` says how many rows of left have the key.
    Rows of frequent keys stay where they are and meet a broadcast: there are fewer than HOT such keys."""
    n, most = right.agg(F.sum("_n"), F.max("_n")).first()
    limit, right_rows = max(LEAST_HOT, (n or 0) / HOT), right.drop("_n")
    if (most or 0) <= limit:
        return left.join(right_rows, key)
    hot = F.broadcast(right.filter(F.col("_n") > limit).drop("_n"))
    others = left.join(hot.select(*key), key, "left_anti").join(right.filter(F.col("_n") <= limit).drop("_n"), key)
    return left.join(hot, key).unionByName(others)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
