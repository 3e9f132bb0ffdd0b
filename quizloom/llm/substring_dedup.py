"""Operator 2: removal of repeated passages with a log-structured fingerprint index.

Every run of WINDOW words has an anchor: the smallest hash among the GRAM-word sequences in it. Equal windows have equal
anchors, so only windows whose anchor was seen before can repeat one. The index holds anchors only, as immutable sorted
runs, one for each batch; a new batch is sorted and merge-joined with the runs, and runs are compacted when FAN_IN of a
level have gathered. It can be saved and opened by a later job. What it matches is then verified: the words of the candidate
windows, by a digest of their text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import Words, blocks, documents, group_bounds, group_count, keyed, mix, packed, shared_dir, unpacked, with_null_ids

WINDOW = 20
GRAM = 8
#: A table is read in so many batches of about equal many rows, in the order of doc_id.
BATCHES = 4
FAN_IN = 2
#: Bytes of text in a group of documents, and of those whose anchors fall into one bucket.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 24 << 20
_U64 = np.uint64


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each `width` neighbours; width - 1 shorter than x."""
    have, out = 1, x
    while have * 2 <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class _Anchors:
    """Window anchors of a block: `anchor` by gram (0 where no window starts), `chosen` grams, `row` and `at` of each."""

    def __init__(self, words: Words, window: int, gram: int):
        width = window - gram + 1
        hashes, pick, offsets = words.grams(gram)
        self.row = np.repeat(np.arange(len(words.count)), np.diff(offsets))
        self.at = pick - words.first[self.row]
        n = len(hashes)
        self.hashes, self.anchor = hashes, np.zeros(n, _U64)
        if n >= width:
            starts = self.at <= words.count[self.row] - window
            low = _sliding(hashes, width, np.minimum)
            self.anchor[: len(low)] = np.where(starts[: len(low)], np.maximum(low, _U64(1)), _U64(0))
        behind = np.concatenate([np.zeros(width - 1, _U64), self.anchor])
        self.chosen = np.flatnonzero((np.maximum(hashes, _U64(1)) == _sliding(behind, width, np.maximum)) if n else np.zeros(0, bool))


def _by_group(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    order = np.argsort(key, kind="stable")
    keys, bounds = group_bounds(key[order])
    return keys, [packed(c[order], bounds) for c in columns]


INDEX = "kind int, key int, hashes binary, places binary"
RUN, SEEN = 0, 1


def _rows(kind: int, key: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    keys, (h, p) = _by_group(key.astype(np.int32), hashes, places)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), h, p], names=["kind", "key", "hashes", "places"])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes.copy()) % _U64(buckets)).astype(np.int32)


class FingerprintIndex:
    """Sorted immutable runs of anchors, each with the place (see keyed) of a document that has it.

    add() returns, for a batch, the pairs of anchor and place that have to be verified: those of the batch that the index or
    the batch itself repeats, and those of the index that the batch repeats. save() notes the runs under `path`, from where
    opened() takes them up again; a path must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, buckets: int, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN, path: str | None = None):
        self.spark, self.buckets, self.window, self.gram, self.fan_in = spark, buckets, window, gram, fan_in
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        #: (level, path): tables with a row for each bucket, hashes ascending.
        self.runs: list[tuple[int, str]] = []

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        notes = spark.read.parquet(f"{path}/notes").orderBy(F.desc("at")).first()
        out = cls(spark, notes["buckets"], notes["window"], notes["gram"], notes["fan_in"], path)
        out.runs = [(r["level"], r["run"]) for r in notes["runs"]]
        return out

    def save(self) -> None:
        kind = "window int, gram int, fan_in int, buckets int, runs array<struct<level:int,run:string>>"
        notes = self.spark.createDataFrame([(self.window, self.gram, self.fan_in, self.buckets, self.runs)], kind)
        notes.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/notes")

    def _written(self, found: DataFrame) -> str:
        at = f"{self.path}/run-{uuid.uuid4().hex}"
        found.write.option("compression", "zstd").parquet(at)
        return at

    def _run(self, at: str) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(at).filter(F.col("kind") == RUN)

    def _entries(self, batch: DataFrame, groups: int) -> DataFrame:
        window, gram, buckets = self.window, self.gram, self.buckets

        def flush(hashes: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, p = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, p = h[order], p[order]
            keys, bounds = group_bounds(h)
            often = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            yield _rows(RUN, _bucket(keys, buckets), keys, p[bounds[:-1]])
            yield _rows(SEEN, buckets + np.mod(p[often], groups), h[often], p[often])

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, places, held = [], [], 0
            for block in blocks(batches):
                words = Words(block.column("text"))
                a = _Anchors(words, window, gram)
                hashes.append(np.maximum(a.hashes[a.chosen], _U64(1)))
                places.append(block.column("place").to_numpy()[a.row[a.chosen]])
                held += len(words.data)
                if held >= CHUNK_BYTES:
                    yield from flush(hashes, places)
                    hashes, places, held = [], [], 0
            if hashes:
                yield from flush(hashes, places)

        return batch.select("place", "text").mapInArrow(entries, INDEX)

    def add(self, batch: DataFrame, groups: int) -> DataFrame:
        """batch: text and place as keyed() gives them. Returns rows (kind SEEN, key: group, hashes, places)."""
        buckets = self.buckets
        self.compact()
        new = self._entries(batch, groups).withColumn("old", F.lit(False))
        for _, run in self.runs:
            new = new.unionByName(self._run(run).withColumn("old", F.lit(True)))

        def merge(table: pa.Table) -> pa.Table:
            if table.column("kind")[0].as_py() == SEEN:
                return table.select(["kind", "key", "hashes", "places"]).set_column(1, "key", pa.array(table.column("key").to_numpy() - buckets))
            old = table.column("old").to_numpy()
            own = table.filter(pa.array(~old))
            hashes, places = unpacked(own.column("hashes"), "<u8"), unpacked(own.column("places"), "<i8")
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], places[order]
            keys, bounds = group_bounds(hashes)
            known = np.zeros(len(keys), bool)
            seen_hashes, seen_places = [], []
            for h, p in zip(*(table.filter(pa.array(old)).column(c).to_pylist() for c in ("hashes", "places")), strict=True):
                h, p = np.frombuffer(h, "<u8"), np.frombuffer(p, "<i8")
                at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
                hit = h[at] == keys
                known |= hit
                seen_hashes.append(keys[hit])
                seen_places.append(p[at[hit]])
            again = np.repeat(known | (np.diff(bounds) > 1), np.diff(bounds))
            seen_hashes, seen_places = np.concatenate([hashes[again], *seen_hashes]), np.concatenate([places[again], *seen_places])
            out = [_rows(SEEN, np.mod(seen_places, groups), seen_hashes, seen_places)]
            out.append(_rows(RUN, np.full(int((~known).sum()), table.column("key")[0].as_py()), keys[~known], places[bounds[:-1]][~known]))
            return pa.Table.from_batches(out)

        at = self._written(new.groupBy("key").applyInArrow(merge, INDEX))
        self.runs.append((0, at))
        return self.spark.read.schema(INDEX).parquet(at).filter(F.col("kind") == SEEN)

    def compact(self) -> None:
        """Merge the runs of every level that has FAN_IN of them into one of the next level."""

        def merge(table: pa.Table) -> pa.Table:
            hashes, places = unpacked(table.column("hashes"), "<u8"), unpacked(table.column("places"), "<i8")
            order = np.argsort(hashes, kind="stable")
            return pa.Table.from_batches([_rows(RUN, np.full(len(hashes), table.column("key")[0].as_py()), hashes[order], places[order])])

        for level in sorted({k for k, _ in self.runs}):
            own = [run for k, run in self.runs if k == level]
            if len(own) < self.fan_in:
                continue
            union = self._run(own[0])
            for run in own[1:]:
                union = union.unionByName(self._run(run))
            merged = self._written(union.groupBy("key").applyInArrow(merge, INDEX))
            self.runs = [(k, run) for k, run in self.runs if k != level] + [(level + 1, merged)]


WINDOWS = "kind int, key int, docs binary, places binary, pos binary, size binary, anchors binary, digests binary"
REMOVED = "key int, places binary, pos binary, size binary"
CHECK, REPEATED = 0, 1


class _Windows:
    """Candidate windows: document, its place, the word it starts at, anchor and digest. They are ordered by doc, then place
    (which tells rows with equal doc_id apart), then word."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, ...]]) -> _Windows:
        none = (np.zeros(0, t) for t in ("<i8", "<i8", "<i8", "<u8", "<u8"))
        return cls(*(np.concatenate([empty, *(f[k] for f in found)]) for k, empty in enumerate(none)))

    def take(self, chosen: np.ndarray) -> _Windows:
        return _Windows(*(c[chosen] for c in self.columns))

    def first(self) -> np.ndarray:
        """Whether each window is the first of those with its anchor and digest."""
        doc, place, pos, anchor, digest = self.columns
        order = np.lexsort((pos, place, doc, digest, anchor))
        a, d = anchor[order], digest[order]
        out = np.ones(len(doc), bool)
        out[order[1:]] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        return out

    def runs(self, by_anchor: bool) -> tuple[_Windows, np.ndarray]:
        """The windows in order, and the bounds of their runs: consecutive windows of one document (with one anchor)."""
        doc, place, pos, _, _ = self.columns
        own = self.take(np.lexsort((pos, place, doc)))
        doc, place, pos, anchor, _ = own.columns
        if not len(doc):
            return own, np.zeros(1, np.int64)
        cut = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        if by_anchor:
            cut |= anchor[1:] != anchor[:-1]
        return own, np.concatenate([[0], np.flatnonzero(cut) + 1, [len(doc)]])

    def to_check(self, buckets: int) -> pa.RecordBatch:
        own, bounds = self.runs(True)
        doc, place, pos, anchor, digest = own.columns
        first, size = bounds[:-1], np.diff(bounds)
        key = _bucket(anchor[first], buckets)
        inside = np.argsort(np.repeat(key, size), kind="stable")
        _, spans = group_bounds(np.repeat(key, size)[inside])
        keys, columns = _by_group(key, doc[first], place[first], pos[first].astype("<u4"), size.astype("<u4"), anchor[first])
        return _batch(WINDOWS, np.full(len(keys), CHECK, np.int32), keys, *columns, packed(digest[inside], spans))

    def repeated(self, groups: int, base: int = 0) -> tuple[np.ndarray, list[pa.Array]]:
        """By group of documents (its number after `base`): places, words and lengths of the runs."""
        own, bounds = self.runs(False)
        _, place, pos, _, _ = own.columns
        first = bounds[:-1]
        return _by_group((base + np.mod(place[first], groups)).astype(np.int32), place[first], pos[first].astype("<u4"), np.diff(bounds).astype("<u4"))


def _batch(kind: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in kind.split(", ")])


def _once(docs: pa.Table) -> np.ndarray:
    """False for rows that repeat one before them in doc_id and text."""
    out = np.zeros(docs.num_rows, bool)
    out[np.unique(docs.column("place").to_numpy(), return_index=True)[1]] = True
    return out


def _candidate_windows(docs: pa.Table, seen: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    for block in blocks(iter(docs.to_batches())):
        words = Words(block.column("text"))
        a = _Anchors(words, window, gram)
        hit = np.flatnonzero(a.anchor)
        place = np.minimum(np.searchsorted(seen, a.anchor[hit]), len(seen) - 1)
        hit = hit[seen[place] == a.anchor[hit]]
        if not len(hit):
            continue
        first = words.first[a.row[hit]] + a.at[hit]
        text, start = _single_spaced(words)
        stop = start[first + window] - 1
        view = memoryview(text)
        digest = np.frombuffer(b"".join([hashlib.blake2b(view[s:e], digest_size=8).digest() for s, e in zip(start[first].tolist(), stop.tolist(), strict=True)]), "<u8")
        doc, place = (block.column(c).to_numpy()[a.row[hit]] for c in ("doc_id", "place"))
        yield doc, place, a.at[hit], a.anchor[hit], digest


def _single_spaced(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The words (or those kept), each with one space after it, and the byte at which each begins (n + 1 values)."""
    s, e = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    size = e - s + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(s - begin[:-1], size)
    at += np.arange(begin[-1])
    at[begin[1:] - 1] = 0
    out = words.data[at] if len(at) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 32
    return out.tobytes(), begin


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False, index: FingerprintIndex | None = None, history: DataFrame | None = None
) -> DataFrame:
    """Words of each document that no repeated window covers.

    Returns doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for, one row for each of docs. Null and empty
    texts have no words. Of a repeated passage the first stays: that with the smallest doc_id, then position. A null doc_id
    comes before all others; rows with equal doc_id are documents of their own, in the order of a hash of their text, and of
    rows that are equal in text as well the first alone counts as such. Other columns are not read.

    index, history: an index that earlier documents are in already, and these documents. Passages of docs that they have with
    a smaller doc_id go as well; the index takes up docs and is saved.
    """
    spark = docs.sparkSession
    at = [k / batches for k in range(1, batches)]
    told = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.percentile_approx("doc_id", at, 1000).alias("cuts")).first()
    groups = group_count(told["size"], GROUP_BYTES)
    rows = keyed(docs, groups)
    used = index or FingerprintIndex(spark, group_count(told["size"], BUCKET_BYTES), window, gram)
    buckets = used.buckets
    seen = None
    cuts = sorted(set(told["cuts"] or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows if low is None else rows.filter(F.col("doc_id") > low)
        found = used.add(batch if high is None else batch.filter(F.col("doc_id") <= high), groups)
        seen = found if seen is None else seen.unionByName(found)
    if index is not None:
        index.save()
    searched = rows
    if history is not None:
        searched = rows.unionByName(keyed(history, groups).join(_places(seen), "place", "left_semi").select(*rows.columns))

    def candidates(docs: pa.Table, seen: pa.Table) -> pa.Table:
        hashes = np.unique(unpacked(seen.column("hashes"), "<u8")) if seen.num_rows else np.zeros(0, "<u8")
        found = list(_candidate_windows(docs.filter(pa.array(_once(docs))), hashes, window, gram)) if len(hashes) and docs.num_rows else []
        every = _Windows.of(found)
        first = every.first()
        keys, again = every.take(~first).repeated(groups, buckets)
        none = pa.nulls(len(keys), pa.binary())
        return pa.Table.from_batches([every.take(first).to_check(buckets), _batch(WINDOWS, np.full(len(keys), REPEATED, np.int32), keys, none, *again, none, none)])

    def later(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == REPEATED:
            return table.select(["key", "places", "pos", "size"]).set_column(0, "key", pa.array(table.column("key").to_numpy() - buckets))
        size = unpacked(table.column("size"), "<u4").astype(np.int64)
        doc, place, anchor = (np.repeat(unpacked(table.column(c), k), size) for c, k in (("docs", "<i8"), ("places", "<i8"), ("anchors", "<u8")))
        base = np.cumsum(size) - size
        pos = np.repeat(unpacked(table.column("pos"), "<u4").astype(np.int64) - base, size) + np.arange(len(doc))
        every = _Windows(doc, place, pos, anchor, unpacked(table.column("digests"), "<u8"))
        keys, again = every.take(~every.first()).repeated(groups)
        return pa.Table.from_batches([_batch(REMOVED, keys, *again)])

    def keep(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if with_text:
            names, kinds = [*names, "kept_text"], [*kinds, pa.string()]
        place, pos, size = (unpacked(repeated.column(c), k) for c, k in (("places", "<i8"), ("pos", "<u4"), ("size", "<u4")))
        order = np.argsort(place, kind="stable")
        place, pos, size = place[order], pos[order].astype(np.int64), size[order].astype(np.int64)
        out = [pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)]
        once, done = _once(docs), 0
        for block in blocks(iter(docs.to_batches())):
            words = Words(block.column("text"))
            ids = block.column("place").to_numpy()
            change = np.zeros(len(words.start) + 1, np.int64)
            a, b = np.searchsorted(place, ids, "left"), np.searchsorted(place, ids, "right")
            pick = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
            start = np.repeat(words.first[:-1], b - a) + pos[pick]
            np.add.at(change, start, 1)
            np.add.at(change, start + size[pick] - 1 + window, -1)
            kept = np.cumsum(change)[:-1] == 0
            copy = ~once[done : done + block.num_rows] & (words.count >= window)  # all its windows are in the row before it
            done += block.num_rows
            kept &= ~np.repeat(copy, words.count)
            text, begin = _single_spaced(words, kept)
            ends = np.concatenate([[0], np.cumsum(kept)])[words.first]
            view = memoryview(text)
            spans = [(s, max(s, e - 1)) for s, e in zip(begin[ends[:-1]].tolist(), begin[ends[1:]].tolist(), strict=True)]
            columns = [block.column("doc_id"), pa.array(words.count), pa.array(words.count - np.diff(ends)), pa.array([hashlib.sha256(view[s:e]).hexdigest() for s, e in spans], pa.string())]
            if with_text:
                columns.append(pa.array([text[s:e].decode() for s, e in spans], pa.string()))
            out.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(out)

    windows = searched.groupBy("of").cogroup(seen.select("key", "hashes").groupBy("key")).applyInArrow(candidates, WINDOWS)
    repeated = windows.groupBy("key").applyInArrow(later, REMOVED)
    kept = rows.groupBy("of").cogroup(repeated.groupBy("key")).applyInArrow(keep, RESULT + ", kept_text string" * with_text)
    return with_null_ids(kept)


def _places(seen: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(unpacked(batch.column("places"), "<i8")))], names=["place"])

    return seen.select("places").mapInArrow(read, "place long").distinct()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
