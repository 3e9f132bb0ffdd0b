"""Operator 5: language-model scores by online logistic context mixing.

A text is read as the bits of a prefix code over its bytes. Predictors with different contexts (two bytes, four bytes,
the word so far) give each bit a probability from counts over all training texts, less the byte itself where it is one of
them. A gate, how often the contexts were met, chooses the weights that combine the predictors in the logistic domain (the
word so far has all weight where it has met one bit only, and often). The
weights, and a last stage that corrects the odds they give, are refined online: all texts of a group advance together by a
byte, and after each byte follow the error of the group's training texts. The base score is a unigram model over words. The
counts of words, and of bytes after each context, are added up by bucket and returned to the groups of documents that ask
for them, so both models grow with the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import NO_ID, Words, blocks, documents, group_bounds, group_count, keyed, mix, packed, powers, raw_bytes, stored, unpacked, with_null_ids

#: Two bytes, four bytes, the word so far.
CONTEXTS = 3
#: Bytes of text in a group of documents, and of those whose contexts fall into one bucket.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: Groups and buckets of a small table.
LEAST = 16
#: Texts that are read at once hold so many bytes together, or are one.
TEXT_BYTES = 1 << 20
#: A text of more bytes advances in several stretches side by side.
STRETCH = 2048
#: So many bytes of all texts of a group are mixed at once; a bit takes some 40 bytes of memory.
MIX_BYTES = 1 << 18
#: A gate: how sure the word so far is (SURENESS steps, and whether it has met both bits), and how sure four bytes are.
SURENESS = 16
GATES = 4 * SURENESS
#: What the weights begin with, the step of a weight on the mean error of a gate, and how many bits halve that step.
FIRST = 0.4
PRIOR = 0.1
RATE = 0.15
FEW = 50
#: Odds are corrected in so many buckets, half a unit of log odds wide, for each sureness of the word so far.
ODDS = 32
END = 255
_LN10 = float(np.log(10))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64


def held_out() -> F.Column:
    """A null doc_id is in training."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(7)) == 2


@dataclass
class Code:
    """A prefix code: by byte, where its bits begin in `node` and `bit`, and how many there are."""

    first: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    heap = [(int(n) + 1, k, None) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], fresh, (a, b)))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo = [(heap[0], [])]
    while todo:
        (_, name, below), path = todo.pop()
        if below is None:
            paths[name] = path
        else:
            todo += [(below[b], [*path, (name - 256, b)]) for b in (0, 1)]
    size = np.array([len(paths[k]) for k in range(256)])
    steps = [s for k in range(256) for s in paths[k]]
    depth = np.concatenate([np.arange(n) for n in size])
    return Code(np.cumsum(size) - size, size, np.array([n for n, _ in steps], np.uint32), np.array([b for _, b in steps], np.uint8), depth)


def _with_end(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of each text and one END after it, and row offsets."""
    data, at = raw_bytes(column)
    rows = len(at) - 1
    out = np.full(len(data) + rows, END, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(at))] = _LOWER[data]
    return out, at + np.arange(rows + 1)


def _pairs(b: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each byte and predictor the pair of the context before it and the byte: the predictor in 2 bits, the context in
    40 (two bytes and four bytes as they are, the word so far as a hash), the byte in 8."""
    n = len(b)
    x = b.astype(_U64)
    row_start = np.repeat(at[:-1], np.diff(at))
    since = np.arange(n) - row_start
    back = []
    for k in range(1, 5):
        y = np.full(n, 32, _U64)
        y[k:] = x[:-k]
        y[since < k] = 32
        back.append(y)
    two = back[0] | back[1] << _U64(8)
    four = two | back[2] << _U64(16) | back[3] << _U64(24)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U64)
    np.cumsum((x + _U64(1)) * up[:n], out=sums[1:])
    space = (back[0] == 32) | (back[0] == 10)
    begin = np.maximum.accumulate(np.where(space | (since == 0), np.arange(n), 0)) if n else np.zeros(0, np.int64)
    word = (sums[:-1] - sums[begin]) * down[begin]
    word ^= word >> _U64(32)
    word = (word * _U64(0xD6E8FEB86659FD93) + _U64(7)) >> _U64(24)
    return [_U64(k << 48) | c << _U64(8) | x for k, c in enumerate((two, four, word))]


def _events(b: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """For each bit of each byte, the byte it belongs to and its place in the code."""
    size = code.size.take(b)
    of = np.repeat(np.arange(len(b), dtype=np.int32), size)
    place = np.arange(len(of), dtype=np.int32)
    place -= np.repeat((np.cumsum(size) - size - code.first[b]).astype(np.int32), size)
    return of, place


def _byte_counts(rows: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(256, np.int64)
        for block in blocks(batches):
            held += np.bincount(_with_end(block.column("text"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(held)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in rows.select("text").mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r["byte"]] = r["n"]
    return out


def _visits(pairs: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs, all that there are of each of their contexts, and how often each was met. For each pair in
    turn, how often its context reached each node on the way of its byte, and the byte; and where each pair begins."""
    byte = (pairs & _U64(255)).astype(np.uint8)
    of, place = _events(byte, code)
    context = pairs >> _U64(8)
    rank = np.cumsum(np.concatenate([[False], context[1:] != context[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    node, _ = pd.factorize(rank.take(of) * 256 + code.node.take(place))
    out = np.empty(len(of) + len(pairs))
    out[np.arange(len(of)) + of] = np.bincount(node, weights=counts.take(of))[node] if len(of) else 0
    size = code.size.take(byte) + 1
    ends = np.cumsum(size)
    out[ends - 1] = counts
    return out, ends - size


def _told(visits: np.ndarray) -> np.ndarray:
    """Counts in a byte each, an eighth of a doubling apart; small ones are exact but for rounding."""
    return np.rint(8 * np.log2(np.maximum(visits, 0) + 1)).astype(np.uint8)


_COUNTS = np.exp2(np.arange(256) / 8) - 1
_COUNTS[[0, 8, 13, 16, 19, 21]] = np.arange(6)


@dataclass
class Slots:
    """What is known of each node on the way of each pair, for a byte that is not in training, and for one that is and does
    not count itself: the log odds of the bit that is taken, and how sure they are, together in one integer."""

    begin: np.ndarray  # by pair
    known: np.ndarray  # 2 x nodes

    @classmethod
    def read(cls, pairs: np.ndarray, told: np.ndarray, code: Code) -> Slots:
        """told: for each pair in turn, for each node on the way of its byte, how often its context turned off there and went on.
        Both sides of a node are rounded alike wherever it is read, so the odds of its two bits are each other's opposite and
        the probabilities of all bytes sum to one."""
        size = code.size.take((pairs & _U64(255)).astype(np.uint8))
        other, taken = _COUNTS[told].reshape(-1, 2).T
        known = []
        for own in (0, 1):
            k = np.maximum(taken - own, 0)
            sure = np.searchsorted(SURE, k + other + 0.5) * 2 + ((k > 0) & (other > 0))
            known.append((np.rint(np.log((k + PRIOR) / (other + PRIOR)) * SCALE).astype(np.int32) << 4) | sure.astype(np.int32))
        return cls((np.cumsum(size) - size).astype(np.int32), np.concatenate(known))


#: A slot is the surer the more of these counts it has reached. Odds are kept to a part of SCALE.
SURE = np.array([1, 2, 4, 8, 32, 128, 1024])
SCALE = 1024


def _odds(known: np.ndarray) -> np.ndarray:
    return (known >> 4).astype(np.float32) * np.float32(1 / SCALE)


@dataclass
class Mixer:
    """Weights by gate, and corrections of the odds by their bucket and the sureness of the word so far. mixed() refines both."""

    weights: np.ndarray = field(default_factory=lambda: np.full((CONTEXTS, GATES), FIRST, np.float32))
    correction: np.ndarray = field(default_factory=lambda: np.zeros(ODDS * SURENESS, np.float32))

    def step(self, inputs: list[np.ndarray], gate: np.ndarray, sign: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        """Log odds of the bits that are taken, given at one step; weights and corrections follow those that are learnt.
        inputs: log odds of the taken bit by predictor; sign: 1 or -1 for the bit."""
        z = self.weights[0].take(gate) * inputs[0]
        for k in range(1, CONTEXTS):
            z += self.weights[k].take(gate) * inputs[k]
        np.clip(z, -14, 14, out=z)
        bucket = np.clip(z * sign * 2 + ODDS // 2, 0, ODDS - 1).astype(np.int32)
        bucket += gate % SURENESS * np.int32(ODDS)
        final = z + self.correction.take(bucket) * sign
        error, last = learnt / (1 + np.exp(z)), learnt / (1 + np.exp(final)) * sign
        n = np.bincount(gate, learnt, minlength=GATES) + FEW
        for k in range(CONTEXTS):
            self.weights[k] += RATE * np.bincount(gate, error * inputs[k], minlength=GATES) / n
        times = np.bincount(bucket, learnt, minlength=ODDS * SURENESS) + FEW
        self.correction += RATE * np.bincount(bucket, last, minlength=ODDS * SURENESS) / times
        return final

    def mixed(self, b: np.ndarray, at: np.ndarray, learnt: np.ndarray, pairs: list[np.ndarray], slots: Slots, code: Code) -> np.ndarray:
        """log10 probabilities of texts given by bytes, row offsets, whether each row is learnt, and pairs as slots know them.
        Texts advance together by a byte, in stretches of STRETCH."""
        rows = len(at) - 1
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
        since = ((np.arange(len(b), dtype=np.int64) - at[:-1].take(row)) % STRETCH).astype(np.uint16)
        order = np.argsort(since, kind="stable").astype(np.int32)
        _, bounds = group_bounds(since[order])
        nodes = np.int32(len(slots.known) // 2)
        total, first = np.zeros(rows), 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + MIX_BYTES, side="right")) - 1)
            own = order[bounds[first] : bounds[last]]
            bytes_of, texts = b[own], row.take(own)
            of, place = _events(bytes_of, code)
            size, used = code.size.take(bytes_of), learnt.take(texts)
            base = used * nodes - code.first.take(bytes_of).astype(np.int32)  # `place` counts from the start of the code
            at_slot = lambda p, size, place: slots.known.take(np.repeat(slots.begin.take(p.take(own)) + base, size) + place)  # noqa: B023, E731
            word = at_slot(pairs[2], size, place)
            four = at_slot(pairs[1], size, place)
            inputs = [_odds(at_slot(pairs[0], size, place)), _odds(four), _odds(word)]
            gate = (word & 15) + np.int32(SURENESS) * np.minimum((four & 15) >> 2, 3)
            sign = code.bit.take(place).astype(np.float32) * 2 - 1
            counts = np.repeat(used.astype(np.float32), size)
            cuts = np.searchsorted(of, bounds[first : last + 1] - bounds[first]).tolist()
            z = np.empty(len(of), np.float32)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                z[lo:hi] = self.step([x[lo:hi] for x in inputs], gate[lo:hi], sign[lo:hi], counts[lo:hi])
            total -= np.bincount(texts.take(of), np.log1p(np.exp(-z)), minlength=rows)
            first = last
        return total / _LN10


ASKED = "key int, of int, words binary, counts binary, pairs binary, pair_counts binary"
REPLY = "of int, key int, counts binary, visits binary"
TOTALS = -1


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of 64-bit integers, all first bytes first: sorted values are alike in their high bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    n = len(data) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, n).T
    return out.reshape(-1).view("<u8")


PAIR_BYTES = 7


def _numbered(pairs: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As pd.factorize for pairs of two bytes and a byte: over the alphabet of the texts they fit into a table."""
    letters = np.unique(np.append(b, 32))
    n = len(letters)
    if n > 160:
        return pd.factorize(pairs)
    rank = np.zeros(256, np.int32)
    rank[letters] = np.arange(n)
    index = (rank.take((pairs >> _U64(16)) & _U64(255)) * n + rank.take((pairs >> _U64(8)) & _U64(255))) * n + rank.take(b)
    there = np.zeros(n**3, bool)
    there[index] = True
    number = np.cumsum(there, dtype=np.int32) - 1
    distinct = np.zeros(int(number[-1]) + 1, _U64)
    code = number.take(index)
    distinct[code] = pairs
    return code, distinct


def _by_bucket(distinct: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values by bucket, then value, and the place of each in that order."""
    order = np.lexsort((distinct, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


class Asked:
    """What a group of documents needs of the models: its distinct words and pairs, each by bucket and then by value, and
    how often each is in its training texts.

    parts: blocks, with the words of each and their indices; pairs_of: for each block its bytes and, by predictor, the
    indices of their pairs.
    """

    def __init__(self, docs: pa.Table, buckets: int):
        self.parts = [(block, Words(block.column("text"), lower=True)) for block in blocks(iter(docs.to_batches()), limit=TEXT_BYTES)]
        every = np.concatenate([np.zeros(0, _U64), *[w.hash for _, w in self.parts]])
        index, words = pd.factorize(every)
        bucket = (mix(words.copy()) % _U64(buckets)).astype(np.int32)
        order, place = _by_bucket(words, bucket)
        self.words, self.word_bucket, index = words[order], bucket[order], place[index]
        cuts = np.cumsum([0, *[len(w.start) for _, w in self.parts]])
        self.index = [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        train = [~block.column("held_out").to_numpy(zero_copy_only=False) for block, _ in self.parts]
        known = np.concatenate([np.zeros(0, bool), *[np.repeat(t, w.count) for t, (_, w) in zip(train, self.parts, strict=True)]])
        self.counts = np.bincount(index[known], minlength=len(words)).astype("<u8")

        found, met, self.pairs_of = [np.zeros(0, _U64)], [np.zeros(0)], []
        for t, (block, _) in zip(train, self.parts, strict=True):
            b, at = _with_end(block.column("text"))
            learnt = np.repeat(t, np.diff(at))
            codes = []
            for k, p in enumerate(_pairs(b, at)):
                code, distinct = pd.factorize(p) if k else _numbered(p, b)
                found.append(distinct)
                met.append(np.bincount(code[learnt], minlength=len(distinct)).astype(np.float64))
                codes.append(code.astype(np.int32))
            self.pairs_of.append((b, at, learnt, codes))
        index, pairs = pd.factorize(np.concatenate(found))
        bucket = (mix(pairs >> _U64(8)) % _U64(buckets)).astype(np.int32)
        order, place = _by_bucket(pairs, bucket)
        self.pairs, self.pair_bucket = pairs[order], bucket[order]
        self.pair_counts = np.bincount(index, np.concatenate(met), minlength=len(pairs))[order]
        index = place[index].astype(np.int32)
        ends = np.cumsum([len(x) for x in found])
        for n, (_, _, _, codes) in enumerate(self.pairs_of):
            for k in range(CONTEXTS):
                to = 1 + n * CONTEXTS + k
                codes[k] = index[ends[to - 1] : ends[to]].take(codes[k])

def _ask(docs: pa.Table, buckets: int) -> pa.Table:
    """The distinct words and pairs of a group of documents, by bucket, each with how often it is in training texts."""
    asked = Asked(docs, buckets)
    keys = np.union1d(asked.word_bucket, asked.pair_bucket).astype(np.int32)
    of = docs.column("of")[0].as_py() if docs.num_rows else 0
    rows = []
    word_at, pair_at = (np.append(np.searchsorted(bucket, keys), len(bucket)).tolist() for bucket in (asked.word_bucket, asked.pair_bucket))
    for k in range(len(keys)):
        words, pairs = slice(word_at[k], word_at[k + 1]), slice(pair_at[k], pair_at[k + 1])
        rows.append((_planes(asked.words[words], 8), _planes(asked.counts[words], 8), _planes(asked.pairs[pairs], PAIR_BYTES), _planes(asked.pair_counts[pairs], 4)))
    columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.binary())] * 4
    return pa.table([pa.array(keys), pa.array(np.full(len(keys), of, np.int32)), *columns], names=["key", "of", "words", "counts", "pairs", "pair_counts"])


def _joined(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a column in planes, and how many each has."""
    parts = [_from_planes(x, size) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, "<u8"), *parts]), np.array([len(x) for x in parts], np.int64)


def _answer(table: pa.Table, code: Code) -> pa.Table:
    """Add up the counts of a bucket and send each group the totals of the words and the visits of the pairs it asked for,
    in its order."""
    (words, size), (counts, _) = _joined(table.column("words"), 8), _joined(table.column("counts"), 8)
    known, index = np.unique(words, return_inverse=True)
    total = np.zeros(len(known), np.uint64)
    np.add.at(total, index, counts)
    cuts = np.cumsum(size)[:-1]
    totals = np.array([int(total.sum()), int((total > 0).sum())], "<u8")
    of = np.append(table.column("of").to_numpy(), TOTALS).astype(np.int32)
    reply = [_planes(x, 8) for x in np.split(total[index], cuts)]

    (pairs, size), (met, _) = _joined(table.column("pairs"), PAIR_BYTES), _joined(table.column("pair_counts"), 4)
    known, index = np.unique(pairs, return_inverse=True)
    visits, at = _visits(known, np.bincount(index, met, minlength=len(known)), code)
    both = np.zeros((len(visits), 2), np.uint8)  # turned off at a node, and went on
    both[:-1] = np.stack([_told(visits[:-1] - visits[1:]), _told(visits[1:])], axis=1) if len(visits) else 0
    length = code.size.take((known & _U64(255)).astype(np.uint8))[index]
    ends = np.cumsum(np.append(0, length))
    pick = np.repeat(at[index] - ends[:-1], length) + np.arange(ends[-1])
    rows = np.append(0, np.cumsum(size))
    sent = packed(both[pick].reshape(-1), 2 * np.append(ends[rows], ends[-1]))
    key = np.full(len(of), table.column("key")[0].as_py(), np.int32)
    return pa.table({"of": pa.array(of), "key": pa.array(key), "counts": pa.array([*reply, totals.tobytes()], pa.binary()), "visits": sent})


def _sent(table: pa.Table, ascending: dict[str, int] | None = None) -> pa.Table:
    """The table as it goes through the shuffle: values of binary columns by zstd behind their length; ascending columns (bytes
    of a value in planes) by the steps between their values."""
    codec = pa.Codec("zstd")
    for k, f in enumerate(table.schema):
        if pa.types.is_binary(f.type):
            values = table.column(k).to_pylist()
            if ascending and (size := ascending.get(f.name)):
                values = [_planes(np.diff(_from_planes(x, size), prepend=_U64(0)), size) for x in values]
            values = [len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) if x else b"" for x in values]
            table = table.set_column(k, f.name, pa.array(values, pa.binary()))
    return table


def _received(table: pa.Table, ascending: dict[str, int] | None = None) -> pa.Table:
    """What _sent was given."""
    codec = pa.Codec("zstd")
    for k, f in enumerate(table.schema):
        if pa.types.is_binary(f.type):
            values = [codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) if x else b"" for x in table.column(k).to_pylist()]
            if ascending and (size := ascending.get(f.name)):
                values = [_planes(np.cumsum(_from_planes(x, size), dtype=_U64), size) for x in values]
            table = table.set_column(k, f.name, pa.array(values, pa.binary()))
    return table


#: Sorted columns of what is asked, and the bytes of a value.
ASCENDING = {"words": 8, "pairs": PAIR_BYTES}


def _texts_sent(rows: DataFrame) -> DataFrame:
    """rows with their texts by zstd; _texts_received takes them back."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            table = pa.Table.from_batches([block])
            at = table.schema.get_field_index("text")
            yield from _sent(table.set_column(at, "text", table.column(at).cast(pa.binary()))).combine_chunks().to_batches()

    return rows.mapInArrow(send, ", ".join(f"{n} {'binary' if n == 'text' else kind}" for n, kind in rows.dtypes))


def _texts_received(table: pa.Table) -> pa.Table:
    table = _received(table)
    at = table.schema.get_field_index("text")
    return table.set_column(at, "text", table.column(at).cast(pa.string()))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, score double, n_bytes long, tokens long, words long"


def _in_order(replies: pa.Table) -> pa.Table:
    return replies.take(pa.array(np.argsort(replies.column("key").to_numpy(), kind="stable")))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    A text is its words and one end (null and empty texts: the end alone). A byte of a training text does not count
    itself in `score`. Words are told apart by a 64-bit hash.
    Repeated rows are scored and counted one by one; a null doc_id is in training. Without training texts train_tokens
    is 0 and all words are unknown. Other columns are not read.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = group_count(size, GROUP_BYTES, LEAST), group_count(size, BUCKET_BYTES, LEAST)
    rows = keyed(docs, groups)
    rows = rows.withColumn("held_out", F.when(F.col("doc_id") == NO_ID, F.lit(False)).otherwise(held_out()))
    train = rows.filter(~F.col("held_out"))
    code = prefix_code(_byte_counts(train))
    ends = train.count()
    by_group = _texts_sent(rows).groupBy("of")
    asked = by_group.applyInArrow(lambda t: _sent(_ask(_texts_received(t), buckets), ASCENDING), ASKED)
    replies = asked.groupBy("key").applyInArrow(lambda t: _sent(_answer(_received(t, ASCENDING), code)), REPLY)

    def score(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, replies = _texts_received(docs), _received(replies)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "sum_log", "score", "n_bytes", "tokens", "words"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        if not docs.num_rows:
            sums = unpacked(replies.column("counts"), "<u8").reshape(-1, 2).sum(axis=0).tolist() if replies.num_rows else [0, 0]
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None] * 7 + sums, kinds, strict=True)], names=names)])
        docs = docs.take(pa.array(np.argsort(docs.column("place").to_numpy(), kind="stable")))
        asked, replies = Asked(docs, buckets), _in_order(replies)
        logs = np.log10(_joined(replies.column("counts"), 8)[0].astype(np.float64) + 1)
        slots = Slots.read(asked.pairs, unpacked(replies.column("visits"), np.uint8), code)
        length = np.concatenate([np.diff(at) for _, at, _, _ in asked.pairs_of])
        learnt = np.concatenate([~block.column("held_out").to_numpy(zero_copy_only=False) for block, _ in asked.parts])
        b, pairs = np.concatenate([b for b, _, _, _ in asked.pairs_of]), [np.concatenate([p[k] for _, _, _, p in asked.pairs_of]) for k in range(CONTEXTS)]
        scores = Mixer().mixed(b, np.append(0, np.cumsum(length)), learnt, pairs, slots, code)
        cuts = np.cumsum([len(at) - 1 for _, at, _, _ in asked.pairs_of])[:-1]
        out = []
        for (block, w), index, points, size in zip(asked.parts, asked.index, np.split(scores, cuts), np.split(length, cuts), strict=True):
            of = np.repeat(np.arange(len(w.count)), w.count)
            n_known = np.bincount(of, logs[index] > 0, minlength=len(w.count)).astype(np.int64)
            sum_log = np.bincount(of, logs[index], minlength=len(w.count)) + np.log10(ends + 1)
            columns = [block.column("doc_id"), block.column("held_out"), pa.array(w.count + 1), pa.array(n_known + (1 if ends else 0)), pa.array(sum_log), pa.array(points), pa.array(size - 1)]
            out.append(pa.RecordBatch.from_arrays([*columns, pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.int64())], names=names))
        return pa.Table.from_batches(out)

    scored = stored(by_group.cogroup(replies.groupBy("of")).applyInArrow(score, SCORED), "scored")
    totals = scored.filter("tokens is not null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    n, v = totals["n"] + ends, totals["v"] + (1 if ends else 0)
    base = F.col("sum_log") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))
    found = scored.filter("tokens is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
    return with_null_ids(found)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
