"""Operator 4: benchmark decontamination with a q-gram filter.

Benchmark items are cut into overlapping segments. If a text holds a segment with at most e edits, at least
length - q + 1 - q * e of the segment's q-grams occur in it inside a diagonal band e + 1 wide. Shared q-grams are
counted in bands twice as wide that overlap by half, regions that meet the bound are kept, and a banded alignment verifies each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, id_text, raw_bytes

#: Length of q-grams, less for short segments. Items of fewer characters have no q-gram and no edit to spare: they are looked
#: for as they are, between white space or the ends of a text.
Q = 7
LEAST_ITEM = 7
#: Shared q-grams that a region needs at least. The most frequent q-grams of a segment are left out as far as the bound,
#: lowered by as many, stays at this or above; the filter then still loses no region within the budget.
LEAST = 8
SEGMENT = 96
STRIDE = 48
#: Edits allowed for each character of a segment.
RATE = 0.1
#: The segments of one broadcast table hold at most so many bytes; larger benchmarks take several passes over the texts.
TABLE_BYTES = 4 << 20
_U64 = np.uint64

#: Letters lower-case, digits and bytes of other letters as they are, all else white space.
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with runs of white space as one space and none in front; row offsets; of each byte, its place in
    the text of its row."""
    data, at = raw_bytes(column)
    b = _NORMAL[data]
    before = np.full(len(b), 32, np.uint8)
    before[1:] = b[:-1]
    before[at[:-1][at[:-1] < len(b)]] = 32
    keep = np.flatnonzero((b != 32) | (before != 32))
    rows = np.searchsorted(keep, at)
    return b[keep], rows, keep - np.repeat(at[:-1], np.diff(rows))


def _grams(b: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place on, as one number."""
    if len(b) < q:
        return np.zeros(0, _U64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray(len(b) - q + 1, "<u8", padded.data, strides=(1,)) & _U64((1 << (8 * q)) - 1)


@dataclass
class Table:
    """Segments of a benchmark and their q-grams."""

    item: list[int | None]  # by segment
    start: np.ndarray  # of the segment, in its item
    q: int
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray  # shared q-grams that an occurrence within the budget has at least
    least: np.ndarray  # those of them among the q-grams below
    every: list[np.ndarray]  # all q-grams of each segment
    grams: np.ndarray  # distinct q-grams, ascending
    first: np.ndarray  # bounds in the two arrays below
    segment: np.ndarray
    place: np.ndarray
    filter: np.ndarray  # of 2 ** 18 hash values, which occur


def _hash18(g: np.ndarray) -> np.ndarray:
    return (g * _U64(0x9E3779B97F4A7C15)) >> _U64(46)


def _bound(size: int, q: int, rate: float) -> int:
    """Shared q-grams that are left at least by the edits allowed."""
    return size - q + 1 - q * int(size * rate)


def make_tables(items: list[tuple[int | None, str]], q: int = Q, segment: int = SEGMENT, stride: int = STRIDE, rate: float = RATE) -> list[Table]:
    """A table for each length of q-grams. An item of under `segment` characters is one segment, with q-grams as long as the
    bound allows, at most q; items of under LEAST_ITEM characters have none, see make_phrases()."""
    found: dict[int, list[tuple[int | None, int, bytes]]] = {}
    for item, text in items:
        b = normalised(pa.array([text or ""]))[0].tobytes().rstrip()
        if len(b) < LEAST_ITEM:
            continue
        starts = list(range(0, max(1, len(b) - segment + 1), stride))
        if len(b) > segment and starts[-1] != len(b) - segment:
            starts.append(len(b) - segment)
        own = min(len(b), segment)
        length = next(k for k in range(min(q, own), 0, -1) if _bound(own, k, rate) >= 1)
        found.setdefault(length, []).extend((item, s, b[s : s + segment]) for s in starts)
    return [_table(rows, length, rate) for length, rows in sorted(found.items())]


def _table(rows: list[tuple[int | None, int, bytes]], q: int, rate: float) -> Table:
    owner, begins, texts = zip(*rows, strict=True)
    budget = np.array([int(len(t) * rate) for t in texts], dtype=np.int64)
    bound = np.array([_bound(len(t), q, rate) for t in texts], dtype=np.int64)
    grams = [_grams(np.frombuffer(t, np.uint8), q) for t in texts]
    known, times = np.unique(np.concatenate(grams), return_counts=True)
    kept = []
    for g, most in zip(grams, np.maximum(0, bound - LEAST), strict=True):
        often = times[np.searchsorted(known, g)]
        kept.append(np.sort(np.argsort(-often, kind="stable")[most:]))
    least = bound - np.maximum(0, bound - LEAST)
    every = np.concatenate([g[k] for g, k in zip(grams, kept, strict=True)])
    own = np.repeat(np.arange(len(texts)), [len(k) for k in kept])
    place = np.concatenate(kept)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    occurs = np.zeros(1 << 18, bool)
    occurs[_hash18(keys)] = True
    return Table(list(owner), np.array(begins, np.int64), q, list(texts), budget, bound, least, grams, keys, np.append(first, len(every)), own[order], place[order], occurs)


@dataclass
class Phrases:
    """Items of one length under LEAST_ITEM."""

    size: int
    known: np.ndarray  # distinct ones as numbers, ascending
    items: list[list[int | None]]


def make_phrases(items: list[tuple[int | None, str]]) -> list[Phrases]:
    """The short items, by length; an item without letters or digits has none."""
    found: dict[int, dict[int, list[int | None]]] = {}
    for item, text in items:
        b = normalised(pa.array([text or ""]))[0].tobytes().rstrip()
        if 0 < len(b) < LEAST_ITEM:
            found.setdefault(len(b), {}).setdefault(int.from_bytes(b, "little"), []).append(item)
    return [Phrases(size, np.array(sorted(own), _U64), [own[k] for k in sorted(own)]) for size, own in sorted(found.items())]


def _phrase_matches(b: np.ndarray, at: np.ndarray, source: np.ndarray, phrases: Phrases) -> list[tuple[int | None, ...]]:
    """Occurrences of short items that begin and end at white space or an end of the text."""
    g, n = _grams(b, phrases.size), phrases.size
    if not len(g):
        return []
    begins = np.ones(len(b), bool)
    begins[1:] = b[:-1] == 32
    begins[at[:-1][at[:-1] < len(b)]] = True
    ends = np.zeros(len(b) + 1, bool)
    ends[: len(b)] = b == 32
    ends[at[1:]] = True
    k = np.minimum(np.searchsorted(phrases.known, g), len(phrases.known) - 1)
    hit = np.flatnonzero((phrases.known[k] == g) & begins[: len(g)] & ends[n : n + len(g)])
    row = np.searchsorted(at, hit, side="right") - 1
    inside = hit + n <= at[row + 1]
    return [(int(r), item, 0, int(source[i]), int(source[i + n - 1]) + 1, 0) for i, r in zip(hit[inside], row[inside], strict=True) for item in phrases.items[int(k[i])]]


def banded_edits(pattern: bytes, text: bytes, low: int, width: int, budget: int) -> tuple[int, int, int]:
    """Fewest edits of `pattern` against any part of `text` by alignments inside the band of diagonals (place in the text less
    place in the pattern) from `low` on, `width` of them, or budget + 1 if there are more than budget; where that part begins
    and ends."""
    same = text.find(pattern)
    if same >= 0 and low <= same < low + width:
        return 0, same, same + len(pattern)
    p, n, far = np.frombuffer(pattern, np.uint8), len(text), budget + 1
    steps = np.arange(width)
    padded = np.zeros(max(0, len(p) + low + width) + len(p) + n + 2 + max(0, -low), np.uint8)
    shift = max(0, -low) + 1  # text[j] is at padded[j + shift]
    padded[shift : shift + n] = np.frombuffer(text, np.uint8)

    def inside(at: np.ndarray) -> np.ndarray:
        return (at >= 0) & (at <= n)

    at = low + steps
    cost, origin = np.where(inside(at), 0, far), at.copy()
    for i, c in enumerate(p):
        at = low + steps + i + 1  # ends of the part after this row
        replace = cost + (padded[at - 1 + shift] != c)
        replace[at < 1] = far
        delete = np.append(cost[1:] + 1, far)
        best = np.minimum(replace, delete)
        begin = np.where(replace <= delete, origin, np.append(origin[1:], 0))
        best[~inside(at)] = far
        # insertions run along the row: the least of best[k] + (j - k)
        low_cost = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == low_cost, steps, 0))
        cost, origin = np.where(inside(at), low_cost + steps, far), begin[source]
        if cost.min() > budget:
            return far, 0, 0
    k = int(cost.argmin())
    return int(cost[k]), int(origin[k]), len(p) + low + k


MATCH = "doc_id long, item_id long, segment_start long, doc_start long, doc_end long, edits long"


def _matches(b: np.ndarray, at: np.ndarray, source: np.ndarray, table: Table) -> list[tuple[int | None, ...]]:
    q = table.q
    g = _grams(b, q)
    hit = np.flatnonzero(table.filter[_hash18(g)]) if len(g) else np.zeros(0, np.int64)
    if not len(hit):
        return []
    k = np.minimum(np.searchsorted(table.grams, g[hit]), len(table.grams) - 1)
    same = table.grams[k] == g[hit]
    hit, k = hit[same], k[same]
    row = np.searchsorted(at, hit, side="right") - 1
    inside = hit + q <= at[row + 1]
    hit, k, row = hit[inside], k[inside], row[inside]
    if not len(hit):
        return []
    times = table.first[k + 1] - table.first[k]
    entry = np.repeat(table.first[k] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    hit, row, seg, place = np.repeat(hit, times), np.repeat(row, times), table.segment[entry], table.place[entry]
    # bands of diagonals: each as wide as two budgets, overlapping by half, so that any alignment lies inside one
    diagonal = hit - at[row] - place + SEGMENT
    width = table.budget[seg] + 1
    out = []
    found: set[tuple[int, int, int]] = set()  # row, segment, lowest diagonal
    n_seg, n_band = len(table.texts), int(diagonal.max()) + 3
    for half in (0, 1):
        band = (diagonal + half * width) // (2 * width)
        code = np.sort(((row * n_seg + seg) * n_band + band) * SEGMENT + place)
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] // SEGMENT  # a q-gram of the segment counts once in a band
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.diff(np.append(starts, len(code)))
        code = code[starts]
        s = code // n_band % n_seg
        for i in np.flatnonzero(count >= table.least[s]):
            w = int(table.budget[s[i]]) + 1
            lo = int(code[i] % n_band) * 2 * w - half * w - SEGMENT
            found.add((int(code[i] // n_band // n_seg), int(s[i]), lo))
    best: dict[tuple[int, int, int, int], int] = {}
    for r, s, lo in sorted(found):
        size, budget = len(table.texts[s]), int(table.budget[s])
        low, width = lo - budget, 4 * budget + 2
        begin, end = max(0, low), min(int(at[r + 1] - at[r]), lo + size + 3 * budget + 2)
        region = b[at[r] + begin : at[r] + end]
        if np.isin(table.every[s], _grams(region, q)).sum() < table.bound[s]:
            continue  # with the frequent q-grams as well it misses the bound
        edits, x, y = banded_edits(table.texts[s], region.tobytes(), low - begin, width, budget)
        if edits <= budget and y > x:
            first, last = source[at[r] + begin + x], source[at[r] + begin + y - 1]
            key = (r, s, int(first), int(last) + 1)
            best[key] = min(edits, best.get(key, edits))
    return [(r, table.item[s], int(table.start[s]), first, last, edits) for (r, s, first, last), edits in best.items()]


@dataclass
class Searched:
    """What one pass over the texts looks for."""

    tables: list[Table]
    phrases: list[Phrases]

    def matches(self, texts: pa.Array) -> list[tuple[int | None, ...]]:
        """Row, item, segment_start, doc_start, doc_end and edits of all that is found in the texts of a block."""
        b, at, source = normalised(texts)
        if not len(b):
            return []
        return [m for t in self.tables for m in _matches(b, at, source, t)] + [m for p in self.phrases for m in _phrase_matches(b, at, source, p)]


def _passes(benchmark: DataFrame) -> Iterator[Searched]:
    """At most TABLE_BYTES of items each, read one after the other: no more of them than that at once."""
    held, size = [], 0

    def made() -> Searched:
        return Searched(make_tables(held), make_phrases(held))

    for r in benchmark.filter("text is not null").select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= TABLE_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, segment_start (in the normalised item), doc_start, doc_end (UTF-8 bytes of the text) and edits of
    every segment found, each place once. Needs doc_id and text, item_id and text; null texts, and items without a letter or
    digit, have no segments; an empty benchmark gives no rows; repeated rows repeat their matches; null ids of documents and of
    items are kept."""
    rows = id_text(docs)
    out = docs.sparkSession.createDataFrame([], MATCH)
    for searched in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(searched)  # TABLE_BYTES of text at most

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                found = shared.value.matches(block.column("text"))
                if found:
                    ids = block.column("doc_id").take(pa.array([f[0] for f in found]))
                    columns = [pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[1:]]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "segment_start", "doc_start", "doc_end", "edits"])

        out = out.unionByName(rows.mapInArrow(search, MATCH))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each pair of document and item: doc_id, item_id, n_segments, doc_start, doc_end, edits (the fewest)."""
    found = find_contamination(docs, benchmark).groupBy("doc_id", "item_id")
    return found.agg(F.countDistinct("segment_start").alias("n_segments"), F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.min("edits").alias("edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text holds a benchmark segment. Each row is judged by its text alone, where it stands:
    rows that share a doc_id, or have none, stay or go by themselves. Null texts stay."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for searched in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(searched)  # TABLE_BYTES of text at most

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                stay = np.ones(block.num_rows, bool)
                stay[[m[0] for m in shared.value.matches(block.column("text"))]] = False
                yield block if stay.all() else block.filter(pa.array(stay))

        docs = docs.mapInArrow(clean, kinds)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
