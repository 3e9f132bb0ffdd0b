"""Operator 11: the trie of conversation prefixes, by Patricia construction.

A rebuilt conversation is a path: a block of BLOCK bytes for each turn (a digest of role and text, and the words of the text).
Distinct paths are sorted over the cluster by ranges. A task reads its range in order and keeps a stack: nodes are created
only where paths branch, end or are leaves, edges are compressed, and the aggregates of a node are final when the stack leaves
it. The two paths at the ends of a range reach into other ranges; they alone are kept turn by turn (the spine: two paths for
each task), and their parts are added up by prefix. Unary nodes come last, out of suffix sums over the edges.

A node's conversations in the subtree, its smallest member and its leaves are sums over a stretch of sorted paths. What a
subtree saves is what lies below a node's lower end, plus (members - 1) times the words from the node to that end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.llm.common import stored

#: Bytes of a turn in a path: a digest of role and text, then the words of the text, big-endian.
DIGEST, BLOCK = 16, 20
FAMILY, MOST_SHARED = 20, 4
FLUSH_ROWS = 4096
FLUSH_IDS = 1 << 16
NONE_SHA = hashlib.sha256(b"").hexdigest()

#: A compressed edge and its lower point: members, smallest member, leaves; children and words saved below the point; suffix
#: sums of words over the edge, its top node first; the key of the point, by which its ends are found. Parents on the spine are told by
#: (part, side, parent_depth), others by parent_conv.
EDGE = "part int, side int, parent_depth int, depth int, parent_conv long, n long, conv long, leaves long, kids long, below long, sums array<long>, key binary"
#: A node of the spine: its prefix and that of its parent, words of its turn, and what this range adds to it.
SPINE = "part int, side int, depth int, key binary, parent_key binary, words long, n long, conv long, leaves long, kids long, below long, is_bottom boolean"


def rebuilt(conversations: DataFrame, family: int = FAMILY, shared: int = MOST_SHARED) -> DataFrame:
    """conv_id and path of every conversation after it is rebuilt: h = crc32(conv_id) mod `shared` turns of the first of its
    family (conv_id - conv_id mod `family`), then its own from turn h on.

    Turns are in the order of `turn` (null first), then of the digest of role and text; null role or text counts as empty. Rows
    with a null conv_id belong to no conversation. A conversation without turns has an empty path. A conversation's digests
    (some 60 bytes a turn) are one value in memory; its texts are not.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), 2 * (BLOCK - DIGEST), "0")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("told"), F.col("turn").cast("long").alias("turn"), F.concat(digest, words).alias("block"))
    own = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("told", F.coalesce("turn", F.lit(0)).alias("turn"), "block"))), lambda x: x["block"]).alias("own"))
    own = stored(own, "turns")
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("source"), F.slice("own", 1, shared).alias("head"))
    with_h = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")).withColumn("source", F.col("conv_id") - F.col("conv_id") % family)
    path = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return with_h.join(heads, "source", "left").select("conv_id", F.unhex(F.array_join(path, "")).alias("path"))


def _words(path: bytes, a: int, b: int) -> np.ndarray:
    """Words of the turns a to b - 1 of a path."""
    return np.frombuffer(path, dtype=np.uint8)[a * BLOCK : b * BLOCK].reshape(-1, BLOCK)[:, DIGEST:].copy().view(">u4").ravel().astype(np.int64)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start on."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(p, dtype=np.uint8, count=n) for p in (a, b))
    different = np.flatnonzero(x != y)
    return int(different[0] if len(different) else n) // BLOCK


class _Node:
    """A point on the stack: an open prefix of the last path, with what is summed so far."""

    __slots__ = ("depth", "path", "n", "conv", "leaves", "kids", "below", "is_first", "waiting")

    def __init__(self, depth: int, path: bytes, is_first: bool):
        self.depth, self.path, self.is_first = depth, path, is_first
        self.n, self.conv, self.leaves, self.kids, self.below = 0, None, 0, 0, 0
        #: Edges of closed children, which are given out when the parent's smallest member is known.
        self.waiting: list[dict] = []


class _Range:
    """The sorted paths of one task: out holds finished edges, spine the nodes of its first and last path."""

    def __init__(self, part: int):
        self.part, self.stack, self.out, self.points = part, [], [], []
        self.first: bytes | None = None
        self.last = b""

    def add(self, path: bytes, conv: int, n: int) -> None:
        if self.first is None:
            self.first = path
            self.stack.append(_Node(0, path, True))
        else:
            self._leave(_common(self.last, path))
        top = self.stack[-1]
        if len(path) > top.depth * BLOCK:
            top = _Node(len(path) // BLOCK, path, path is self.first)
            self.stack.append(top)
        top.n, top.conv = n, conv
        self.last = path

    def _leave(self, depth: int, bottom: bool = False) -> None:
        """Close the points below depth."""
        while self.stack[-1].depth > depth:
            x = self.stack.pop()
            x.leaves = x.leaves or 1
            if self.stack[-1].depth < depth:
                self.stack.append(_Node(depth, x.path, x.is_first))
            up = self.stack[-1]
            up.n += x.n
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            up.leaves += x.leaves
            up.below += x.below
            if x.is_first or bottom:
                self._to_spine(x, 0 if x.is_first else 1)
                continue
            sums = np.cumsum(_words(x.path, up.depth, x.depth)[::-1])[::-1]
            up.below += (x.n - 1) * int(sums[0])
            up.kids += 1
            self._release(x, x.conv, None)
            key = hashlib.md5(x.path[: x.depth * BLOCK]).digest()
            up.waiting.append({"parent_depth": up.depth, "depth": x.depth, "n": x.n, "conv": x.conv, "leaves": x.leaves, "kids": x.kids, "below": x.below, "sums": sums.tolist(), "key": key})
            if up.is_first and len(up.waiting) > FLUSH_ROWS:
                self._release(up, None, 0)

    def _release(self, x: _Node, conv: int | None, side: int | None) -> None:
        for row in x.waiting:
            self.out.append(row | {"part": self.part, "side": side, "parent_conv": conv})
        x.waiting = []

    def _to_spine(self, x: _Node, side: int) -> None:
        self._release(x, None, side)
        self.points.append((side, x))

    def spine(self) -> Iterator[dict]:
        """Close everything, and give the nodes of the first and of the last path, turn by turn."""
        if self.first is None:
            return
        shared = _common(self.first, self.last)
        while len(self.stack) > 1:
            self._leave(self.stack[-2].depth, bottom=True)
        root = self.stack.pop()
        root.leaves = root.leaves or 1
        self._to_spine(root, 0)
        by = {(side, x.depth): x for side, x in self.points}
        for side, path in ((0, self.first), (1, self.last)):
            words, digest, size = _words(path, 0, len(path) // BLOCK), hashlib.md5(), len(path) // BLOCK
            keys = [digest.digest()]
            for k in range(size):
                digest.update(path[k * BLOCK : (k + 1) * BLOCK])
                keys.append(digest.digest())
            rows, below = [], None
            for depth in range(size, -1, -1):
                x = by.get((side, depth))
                below = x or below
                row = {"part": self.part, "side": side, "depth": depth, "key": keys[depth], "parent_key": keys[depth - 1] if depth else None, "words": int(words[depth - 1]) if depth else 0}
                row |= {"n": 0, "conv": None, "leaves": 0, "kids": 0, "below": 0, "is_bottom": side == 1 and depth == size}
                if side == 0 or depth > shared:  # what both paths have is added once
                    row |= {"n": below.n, "conv": below.conv, "leaves": below.leaves, "below": below.below, "kids": x.kids if x else 0}
                rows.append(row)
            yield from rows


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def _compressed(paths: DataFrame) -> DataFrame:
    """Edges and spine nodes, in one column each, of sorted distinct paths (path, conv, n)."""
    edge, node = pa.struct(list(_arrow(EDGE))), pa.struct(list(_arrow(SPINE)))

    def batch(edges: list[dict], nodes: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([*edges, *[None] * len(nodes)], edge), pa.array([*[None] * len(edges), *nodes], node)]
        return pa.RecordBatch.from_arrays(columns, names=["edge", "node"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Range(TaskContext.get().partitionId())
        for b in batches:
            for path, conv, n in zip(*(b.column(c).to_pylist() for c in ("path", "conv", "n")), strict=True):
                own.add(path, conv, n)
                if len(own.out) > FLUSH_ROWS:
                    yield batch(own.out, [])
                    own.out = []
        nodes = list(own.spine())
        for k in range(0, len(own.out), FLUSH_ROWS):
            yield batch(own.out[k : k + FLUSH_ROWS], [])
        for k in range(0, len(nodes), FLUSH_ROWS):
            yield batch([], nodes[k : k + FLUSH_ROWS])

    return paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(build, f"edge struct<{_ddl(EDGE)}>, node struct<{_ddl(SPINE)}>")


def _ddl(schema: str) -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in schema.split(", "))


def _spine_totals(spine: DataFrame) -> DataFrame:
    """The nodes of all spines, by key: parts added up, words saved below, and the nodes' own children on the spine.

    What spine nodes save is summed up each path from the one chain that owns the node; so is the leaf that a range took its last
    path for if the next range goes on from there.
    """
    chain = F.struct("part", "side")
    merged = spine.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"),
        F.sum("kids").alias("kids"), F.sum("below").alias("below"), F.min(chain).alias("owner"),
    )
    children = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = stored(merged.join(children, "key", "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("own", (F.col("n") - 1) * F.col("words")), "spine-nodes")
    rows = spine.join(nodes.select("key", "owner", "own", "more"), "key")
    rows = rows.select("part", "side", "depth", "key", F.when(F.col("owner") == chain, F.col("own")).otherwise(0).alias("own"), F.when(F.col("is_bottom") & (F.col("more") > 0), -1).otherwise(0).alias("fix"))
    lower = Window.partitionBy("part", "side").orderBy(F.desc("depth"))
    strictly = lower.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("under", F.coalesce(F.sum("own").over(strictly), F.lit(0))).withColumn("fixes", F.sum("fix").over(lower.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("key").agg(F.sum("under").alias("under"), F.sum("fixes").alias("fixes"))
    return nodes.join(sums, "key").select(
        "key", "parent_key", "depth", "n", "conv", (F.col("kids") + F.col("more")).alias("n_children"), (F.col("leaves") + F.col("fixes")).alias("n_leaves"), (F.col("own") + F.col("below") + F.col("under")).alias("saved_tokens")
    )


def _ends(members: DataFrame) -> DataFrame:
    """key and ends_sha256: the hash of the ids of the conversations with that path, ascending and comma-joined.

    Ids are sorted over the cluster by ranges of (key, id); a range gives each run of one key in packed chunks, so the task that
    hashes a path with many copies reads about a byte for each and holds one chunk.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            keys, ids = b.column("key").to_pylist(), b.column("conv_id").to_pylist()
            rows, at = [], 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at] and to - at < FLUSH_IDS:
                    to += 1
                rows.append((keys[at], ids[at], zlib.compress(",".join(map(str, ids[at:to])).encode(), 1) if to - at > 4 else ",".join(map(str, ids[at:to])).encode(), to - at > 4))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["key", "id", "ids", "is_packed"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for k, ids, is_packed in zip(*(b.column(c).to_pylist() for c in ("key", "ids", "is_packed")), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(zlib.decompress(ids) if is_packed else ids)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    packed = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key binary, id long, ids binary, is_packed boolean")
    return packed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Nulls, ties and conversations without turns are as in rebuilt(). Other columns are not read; repeated rows are turns of
    their own. No conversations: no rows, not even a root.
    """
    return trie_of_paths(stored(rebuilt(conversations), "paths"))


def trie_of_paths(members: DataFrame) -> DataFrame:
    """prefix_trie() of rebuilt conversations (conv_id, path), a stored table."""
    paths = stored(members.groupBy("path").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")), "distinct-paths")
    both = stored(_compressed(paths), "compressed")
    edges, spine = both.filter("edge is not null").select("edge.*"), both.filter("node is not null").select("node.*")
    ends = _ends(members.select(F.unhex(F.md5("path")).alias("key"), "conv_id"))
    totals = stored(_spine_totals(spine), "spine")
    # the conversation of a parent on the spine, by the place that the parent has in this range
    places = spine.select("part", "side", F.col("depth").alias("parent_depth"), "key").join(totals.select("key", F.col("conv").alias("spine_conv")), "key").drop("key")
    low = edges.join(places, ["part", "side", "parent_depth"], "left").withColumn("up", F.coalesce("parent_conv", "spine_conv"))
    low = low.join(ends, "key", "left").select("parent_depth", "depth", "up", "n", "conv", "leaves", "kids", "below", "ends_sha256", F.posexplode("sums").alias("k", "words"))
    is_point = F.col("parent_depth") + F.col("k") + 1 == F.col("depth")
    none = F.lit(NONE_SHA)
    unary = low.select(
        F.col("conv").alias("conv_id"), (F.col("parent_depth") + F.col("k") + 1).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(is_point, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
        F.when(is_point, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
    parents = totals.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv_id"))
    top = totals.join(ends, "key", "left").join(parents, "parent_key", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
    return unary.unionByName(top)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
