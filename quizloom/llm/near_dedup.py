"""Operator 6: near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with one shingle set are one class from the start. Classes that share a band of their signatures are
candidates. A pair is compared in batches of hashes; after each batch it is dropped if the posterior probability of a
similarity at the threshold or above is under MISS. What is left is verified on the full sets. Buckets of up to SMALL members
are spread into pairs at once and are then done. Larger ones never are: a few rounds link every member of a bucket to one of
its members. After that only members outside the largest component of a bucket are compared with the others, in blocks of
bounded bytes that return a forest of links. No key is joined on without a way for those that many rows have (hot_join).
Signatures and texts of classes that share no bucket are left where they are (_screened).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import Words, blocks, documents, hot_join, id_text, list_array, mix, packed, runs, stored

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
#: Probability of a miss that the pruning of one pair may add.
MISS = 1e-7
STAR_ROUNDS = 2
#: All pairs of a bucket with so many members at most are compared.
SMALL = 8
#: A screen has so many bits for each of its keys, and at most SCREEN_MOST (8 MB) in all.
SCREEN_BITS = 16
SCREEN_MOST = 1 << 26
#: Bytes of signatures and sets on either side of one block.
BLOCK_BYTES = 4 << 20
MEMBER_BYTES = 4 * HASHES + 100
#: Pairs with one document that are verified in one task's group.
FAN = 500
_U64 = np.uint64
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=_U64) * _U64(0xA0761D6478BD642F)) | _U64(1)


def _shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the n + 1 row offsets. Short texts: all words as one."""
    g, _, at = words.grams(k)
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    extra = np.zeros(len(short), _U64)
    for n in range(1, k):
        own = words.count[short] == n
        if own.any():
            h = np.full(int(own.sum()), n, _U64)
            for j in range(n):
                h = mix(h * _U64(0x9FB21C651E98DF25) + words.hash[words.first[short[own]] + j])
            extra[own] = h
    row, g = np.concatenate([row, short]), np.concatenate([g, extra])
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return g[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(size)))])


def _signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, 32 bits each."""
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    low = sets >> _U64(32) ^ sets
    for begin in range(0, len(at) - 1, 256):
        to = min(len(at) - 1, begin + 256)
        own = low[at[begin] : at[to]]
        starts = at[begin:to] - at[begin]
        for k in range(HASHES):
            out[begin:to, k] = (np.minimum.reduceat(own * _SEEDS[k], starts) >> _U64(32)).astype(np.uint32)
    return out


def _read(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text_hash, n_shingles, `same` (a digest of the set) and signature; the last two are null for
    an empty set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets, at = _shingles(Words(block.column("text"), lower=True))
            some = np.flatnonzero(np.diff(at))
            found = _signatures(sets, np.concatenate([at[some], at[-1:]])) if len(some) else np.zeros((0, HASHES), np.uint32)
            rows = np.where(np.diff(at) > 0, np.cumsum(np.diff(at) > 0) - 1, -1)
            signature = packed(found.ravel(), np.arange(len(found) + 1) * HASHES).take(pa.array(rows, pa.int64(), mask=rows < 0))
            columns = [*(block.column(c) for c in ("row", "doc_id", "text_hash")), pa.array(np.diff(at)), pa.array(_digests(sets, at), pa.binary()), signature]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_hash", "n_shingles", "same", "signature"])

    rows = id_text(docs).withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")})
    return rows.mapInArrow(read, "row long, doc_id long, text_hash long, n_shingles long, same binary, signature binary")


def _digests(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    view, ends = memoryview(np.ascontiguousarray(sets).view(np.uint8)), (8 * at).tolist()
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _banded(signed: DataFrame) -> DataFrame:
    """node, n_shingles, and the number and the hash of each of its bands."""
    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.substring("signature", 1 + k * width, width)) for k in range(BANDS)])
    return signed.select("node", "n_shingles", F.posexplode(bands).alias("band", "bucket"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """As stored, for narrow tables of nodes: in three tasks for each core at most, as a file there costs more than its rows."""
    return stored(df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism), name)


def _screened(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose `column` may be one of the keys (one column, stored): all that are, and few others, told by a broadcast
    bitmap of hashes. Without nulls. For the rows before an inner join on the keys goes through the shuffle (Spark would move
    a semi join to before the screen)."""
    bits = min(SCREEN_MOST, -(-SCREEN_BITS * max(1, keys.count()) // 32768) * 32768)
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits)) + 1
    held = keys.select(place(keys.columns[0]).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_word"))
    screen = held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    rows = df.withColumn("_at", place(column)).withColumns({"_word": F.bitmap_bucket_number("_at"), "_bit": F.bitmap_bit_position("_at")})
    octet = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(octet, (F.col("_bit") % 8).cast("int")) == 1
    return rows.join(F.broadcast(screen), "_word").filter(there).select(*df.columns)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and the hashes of its shingles, ascending, for the classes wanted: node, same and low (the doc_id of a text that
    has the set, which may be null)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, at = _shingles(Words(block.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(values, at), pa.binary()), list_array(at, pa.array(values.view(np.int64)))], names=["same", "shingles"])

    rows = id_text(docs)
    ids = wanted.filter("low is not null").select(F.col("low").alias("doc_id"))
    texts = _screened(rows, "doc_id", ids).join(ids.distinct().hint("merge"), "doc_id")
    if not wanted.filter("low is null").isEmpty():
        texts = texts.unionByName(rows.filter("doc_id is null"))
    once = texts.mapInArrow(read, "same binary, shingles array<long>").groupBy("same").agg(F.first("shingles").alias("shingles"))
    return once.join(wanted.select("node", "same"), "same").select("node", "shingles")


@cache
def _least_matches(percent: int = PERCENT) -> tuple[int, ...]:
    """For each batch of hashes, how many must agree so far. With a uniform prior the posterior after m of n matches is
    Beta(m + 1, n - m + 1); a pair goes if the mass above the threshold is under MISS. By the sum of binomials that mass is
    the probability of at most m successes in n + 1 trials at the threshold."""
    s, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        mass, term = 0.0, (1 - s) ** (n + 1)
        m = 0
        while mass + term < MISS and m <= n:
            mass += term
            term *= (n + 1 - m) / (m + 1) * s / (1 - s)
            m += 1
        out.append(m)
    return tuple(out)


def _pruned(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the signature pairs (rows of both) survive all batches."""
    alive, agree = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(_least_matches()):
        span = slice(k * STEP, (k + 1) * STEP)
        agree = agree + (left[alive, span] == right[alive, span]).sum(axis=1)
        stay = agree >= least
        alive, agree = alive[stay], agree[stay]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _spread(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with `column` of both as a_ and b_; a document with many pairs is copied for each FAN of them."""
    fans = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    copies = fans.join(values.withColumnRenamed("node", "a"), "a").withColumn("_part", F.explode(F.sequence(F.lit(0), (F.col("_n") / FAN).cast("int"))))
    many = copies.select("a", "_part", (F.col("_n") / FAN).cast("int").alias("_last"), F.col(column).alias("a_" + column))
    dealt = pairs.join(fans.select("a", (F.col("_n") / FAN).cast("int").alias("_last")), "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_last") + 1).cast("int"))
    found = dealt.drop("_last").join(many.drop("_last"), ["a", "_part"]).drop("_part")
    return found.join(values.select(F.col("node").alias("b"), F.col(column).alias("b_" + column)), "b")


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that Bayesian pruning keeps; a may have many."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("a_signature", "b_signature"))
                yield batch.select(["a", "b"]).filter(pa.array(_pruned(left, right)))

    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    hubs = stored(counts.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("a_signature")), "a"), "hubs")
    both = hot_join(pairs.join(signed.select(F.col("node").alias("b"), F.col("signature").alias("b_signature")), "b"), hubs, ["a"])
    return both.select("a", "b", "a_signature", "b_signature").mapInArrow(prune, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    enough = 100 * shared >= percent * (F.size("a_shingles") + F.size("b_shingles") - shared)
    return _spread(pairs, sets, "shingles").filter(enough).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every end of edges (a, b) but the roots themselves, by alternating
    large and small stars."""
    e = _kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, down = F.sum((F.col("b") < F.col("a")).cast("int")), F.max(F.col("b") > F.col("a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("_n"), ((up > 1) | ((up == 1) & down)).alias("open"))
        low = _kept(low, "stars")
        if low.filter("open").isEmpty():  # a forest of stars around the smallest nodes
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = hot_join(both, low.drop("open"), ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _kept(large, "edges")
        least = _kept(large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("_n")), "stars")
        others = hot_join(large, least, ["a"]).filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = _kept(others.unionByName(least.select("a", F.col("low").alias("b"))).filter("a != b").distinct(), "edges")


BUCKET = ["band", "bucket"]


def _labelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _star_pairs(buckets: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """One member (a) of each bucket that holds several components, with all its members of other components (b); `seed`
    decides which."""
    rows = _kept(_labelled(buckets, roots), "labelled")
    hub = F.min_by(F.struct(F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("n_shingles").alias("a_size")), F.xxhash64("node", F.lit(seed)))
    found = rows.groupBy(BUCKET).agg(hub.alias("h"), F.count(F.lit(1)).alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    hubs = _kept(found.filter("_low < _high").select(*BUCKET, "h.*", "_n"), "hubs")
    return hot_join(rows, hubs, BUCKET).filter("root != a_root").filter(_alike("a_size", "n_shingles")).select("a", F.col("node").alias("b")).distinct()


def _alike(a: str | Column, b: str | Column, percent: int = PERCENT) -> Column:
    """Whether sets of two sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _small_pairs(buckets: DataFrame) -> DataFrame:
    """All pairs (a, b) in buckets of few members that their sizes do not rule out."""
    held = buckets.groupBy(BUCKET).agg(F.sort_array(F.collect_list(F.struct("node", "n_shingles"))).alias("m"))
    both = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    found = held.select(F.explode(F.flatten(both)).alias("p")).filter(_alike("p.x.n_shingles", "p.y.n_shingles"))
    return found.select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b")).distinct()


def _led(links: DataFrame) -> DataFrame:
    """node and root for ends of links (a, b): one that it is linked with. Equal roots are in one component, others may be."""
    return links.groupBy(F.col("b").alias("node")).agg(F.min_by("a", F.xxhash64("a", F.lit(0))).alias("root"))


def _block_links(buckets: DataFrame, roots: DataFrame, signed: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join different components in one bucket. Members outside the largest component of the bucket (the
    left side) meet all members (the right side) in blocks of about BLOCK_BYTES each. There the most alike pairs are verified
    first, on the full sets, and a link makes two components one, so a block returns fewer links than it has members. A pair
    that shares several bands is compared in the first of them."""
    rows = _kept(_labelled(buckets, roots).withColumn("size", F.col("n_shingles") * 8 + MEMBER_BYTES), "labelled")
    sizes = rows.groupBy(*BUCKET, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = sizes.groupBy(BUCKET).agg(F.sum("n").alias("_n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main")).filter("main.n < _n")
    count = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    split = sizes.select(*BUCKET, "_n", F.col("main.root").alias("main"), count(F.col("size") - F.col("main.size")).alias("n_left"), count(F.col("size")).alias("n_right"))
    mixed = stored(hot_join(rows, _kept(split, "mixed"), BUCKET).withColumn("minor", F.col("root") != F.col("main")), "members")
    mixed = mixed.join(signed.select("node", "signature"), "node").join(_screened(sets, "node", mixed.select("node")), "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    sides = F.array(
        F.when(F.col("minor"), F.struct(F.lit(True).alias("left"), F.sequence(F.lit(0), F.col("n_right") - 1).alias("others"))),
        F.struct(F.lit(False).alias("left"), F.sequence(F.lit(0), F.col("n_left") - 1).alias("others")),
    )
    met = mixed.withColumn("side", F.explode(F.array_compact(sides))).withColumn("other", F.explode("side.others"))
    x, y = F.when(F.col("side.left"), part("n_left")).otherwise(F.col("other")), F.when(F.col("side.left"), F.col("other")).otherwise(part("n_right"))
    met = met.select(*BUCKET, x.alias("x"), y.alias("y"), F.col("side.left").alias("left"), "minor", "node", "root", "n_shingles", "signature", "shingles")
    keys = [*BUCKET, "x", "y"]

    def compare(rows: pa.Table) -> pa.RecordBatch:
        node, root, size, band = (rows.column(c).to_numpy().copy() for c in ("node", "root", "n_shingles", "band"))
        left, minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("left", "minor"))
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        held = rows.column("shingles").combine_chunks()
        at, values = held.offsets.to_numpy(), held.values.to_numpy()
        right = np.flatnonzero(~left)
        a, b = [], []
        for i in np.flatnonzero(left):
            j = right[(root[right] != root[i]) & (~minor[right] | (node[right] > node[i]))]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if not len(j):
                continue
            agree = (signature[j] == signature[i]).reshape(len(j), BANDS, ROWS).all(axis=2)
            j = j[agree.argmax(axis=1) == band[0]]
            j = j[_pruned(np.broadcast_to(signature[i], (len(j), HASHES)), signature[j])]
            j = j[np.argsort(-(signature[j] == signature[i]).sum(axis=1), kind="stable")]
            own, many = values[at[i] : at[i + 1]], 4
            while len(j):  # more at once as they get less alike
                now, j = j[:many], j[many:]
                many *= 4
                shared = np.array([len(np.intersect1d(own, values[at[k] : at[k + 1]], assume_unique=True)) for k in now])
                for k in now[100 * shared >= percent * (size[now] + size[i] - shared)]:
                    if root[k] != root[i]:
                        a.append(node[i])
                        b.append(node[k])
                        root[root == root[k]] = root[i]
                j = j[root[j] != root[i]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(compare, runs(batches, keys))

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(by_group, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of docs doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept (has
    it that doc_id), text_hash (xxhash64 of the text) and first (one row of each component: with the smallest doc_id).

    Null texts, and texts without words, have no shingles, link with nothing and are first. Rows with equal doc_id are
    documents of their own. A null doc_id comes after all others: component_id is null only where all of a component are.
    Other columns are not read.
    """
    every = stored(_read(docs), "shingled")
    told = every.filter("same is not null").groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("rep"), F.count(F.lit(1)).alias("_n"))
    heads = stored(told, "classes")
    signed = stored(every.join(heads.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "signature"), "signatures")
    banded = _banded(signed)
    shared = banded.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("members", F.col("_n"))
    buckets = stored(hot_join(banded, stored(shared, "shared"), BUCKET), "buckets")
    small, large = buckets.filter(F.col("members") <= SMALL), buckets.filter(F.col("members") > SMALL).drop("members")
    near = _kept(buckets.select("node").distinct(), "near")
    signed = stored(_screened(signed, "node", near).join(near, "node"), "signatures")
    sets = stored(_sets(docs, stored(_screened(heads, "node", near).join(near, "node"), "wanted")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = stored(_likely(_kept(pairs, "pairs"), signed), "likely")
        return stored(_verified(likely, _screened(sets, "node", likely.select(F.explode(F.array("a", "b")).alias("node")))), "links")

    none = docs.sparkSession.createDataFrame([], "node long, root long")
    if large.isEmpty():
        roots = components(linked(_small_pairs(small)))
    else:
        edges = linked(_small_pairs(small).unionByName(_star_pairs(large, none, 0)))
        for seed in range(1, STAR_ROUNDS):
            edges = edges.unionByName(linked(_star_pairs(large, _led(edges), seed)))
        roots = components(edges)
        more = stored(_block_links(large, roots, signed, sets), "links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    groups = members.join(heads.select("node", "low", "rep"), "node").groupBy("root")
    lowest = _kept(groups.agg(F.min("low").alias("c_low"), F.coalesce(F.min_by("rep", "low"), F.min("rep")).alias("c_rep"), F.count(F.lit(1)).alias("_n")), "components")
    linked = hot_join(members, lowest, ["root"]).select("node", "c_low", "c_rep")
    named = heads.join(linked, "node", "left").select("same", "_n", F.when(F.col("c_rep").isNull(), F.col("low")).otherwise(F.col("c_low")).alias("component_id"), F.coalesce("c_rep", "rep").alias("rep"))
    rows = every.select("row", "doc_id", "text_hash", "n_shingles", "same")
    alone = rows.filter("same is null").withColumns({"component_id": F.col("doc_id"), "rep": F.col("row")})
    out = hot_join(rows.filter("same is not null"), stored(named, "classes"), ["same"]).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash", (F.col("row") == F.col("rep")).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates; all columns of docs. Rows that are equal
    in doc_id and text are one document. A null text is as good as an empty one."""
    found = stored(near_duplicates(docs).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "first"), "near")
    keys = found.groupBy("_doc", "_text").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("times"))
    mine = F.xxhash64(F.coalesce("text", F.lit("")))

    def at(keys: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(keys["_doc"]) & (mine == keys["_text"])

    others = stored(keys.filter("not stays or times > 1"), "others")
    single = docs.join(others.hint("merge"), at(others), "left_anti")
    repeated = others.filter("stays")
    if repeated.isEmpty():
        return single
    again = docs.join(repeated, at(repeated), "left_semi").withColumn("_text", mine).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return single.unionByName(again)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
