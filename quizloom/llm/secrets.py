"""Operator 9: secret scans by grammar inference.

Fixed rules find labelled credentials (the value behind a key word, access keys, long hex). Their values are the training
set of a probabilistic automaton: a prefix tree whose statistically compatible states are merged. A step of the tree is a
character where that one is more frequent than chance, else the smallest class that covers the letters around it, so
prefixes, marks and lengths of a format are kept. Every other candidate token is then scored by its likelihood under that
automaton, its end included, against plain text.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, id_text, raw_bytes, stored

# The patterns of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: All other tokens of this form are candidates; no labelled value is shorter either.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}(?![A-Za-z0-9+/_=-])")
#: The labelled values that are learned from: at most so many distinct ones, in the order of a hash. Of a longer value than
#: LONGEST_VALUE the beginning is learned, and that it does not end there.
SAMPLE = 4000
LONGEST_VALUE = 128
ALPHA = 0.01
#: Bits by which a candidate must be likelier under the automaton than as plain text: what makes up for how rare secrets are.
THRESHOLD = 12.0
#: Probability of a character and of an end where the automaton knows none. An end that no labelled value had in a state costs
#: 20 bits at least, and more the more values have passed it.
FLOOR = 1e-6
#: Decisions on tokens that a worker remembers.
REMEMBERED = 200_000

MARKS = "+/=-_."
_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Character classes, the smallest first.
CLASSES = [frozenset(c) for c in (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _DIGITS + _LOWER, _DIGITS + _UPPER, _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER)]
#: The steps that a character may be: itself, or the number of a class.
STEPS = {c: (c, *(k for k, own in enumerate(CLASSES) if c in own)) for c in _DIGITS + _LOWER + _UPPER + MARKS}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start, then kind; in code points."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, kind, end, value): the base spans, then other candidates (kind 3), which overlap none of them."""
    spans = [(a, k, b, (ASSIGN.match(text, a)[2] if k == 0 else text[a:b])) for a, k, b in base_spans(text)]
    yield from spans
    reach = 0
    base = iter([*spans, (len(text) + 1, 0, 0, "")])
    following = next(base)
    for m in CANDIDATE.finditer(text):
        while following[0] < m.end():
            reach = max(reach, following[2])
            following = next(base)
        if reach <= m.start():
            yield m.start(), OTHER, m.end(), m[0]


OTHER = 3


@dataclass
class _State:
    passed: int = 0
    ended: int = 0
    next: dict[str | int, int] = field(default_factory=dict)
    times: Counter = field(default_factory=Counter)


class Automaton:
    """A probabilistic automaton from positive samples, by merging compatible states of their prefix tree."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = [_State()]
        self._grow(values)
        self._merge_all()

    def _grow(self, values: list[str]) -> None:
        """The prefix tree."""

        def covering(value: str) -> list[int]:
            """For each character the smallest class of the letters between the marks around it."""
            out: list[int] = []
            for part in re.split(f"([{re.escape(MARKS)}])", value):
                out += [next(k for k, own in enumerate(CLASSES) if part in MARKS or own.issuperset(part))] * len(part)
            return out

        todo = [(0, 0, [(v, covering(v)) for v in values])]
        while todo:
            at, depth, own = todo.pop()
            state = self.states[at]
            state.passed = len(own)
            going = [(v, k) for v, k in own if len(v) > depth]
            state.ended = sum(len(v) == depth and depth < LONGEST_VALUE for v, _ in own)
            times, below = Counter(v[depth] for v, _ in going), {}
            for v, k in going:
                c = v[depth]
                often = times[c] / len(going) - 1 / len(CLASSES[k[depth]]) > self.bound / math.sqrt(len(going))
                below.setdefault(c if c in MARKS or often else k[depth], []).append((v, k))
            for step, rest in below.items():
                state.times[step] = len(rest)
                state.next[step] = len(self.states)
                self.states.append(_State())
                todo.append((state.next[step], depth + 1, rest))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on the difference of two frequencies."""
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the whole tree below b agrees with the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            if self._differ(x.ended, x.passed, y.ended, y.passed):
                return False
            for k in {*x.times, *y.times}:
                if self._differ(x.times[k], x.passed, y.times[k], y.passed):
                    return False
                if k in x.next and k in y.next:
                    todo.append((x.next[k], y.next[k]))
        return True

    def _fold(self, a: int, b: int) -> list[int]:
        """Add the tree below b to the automaton at a; the states that get new steps."""
        todo, grown = [(a, b)], []
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            x.passed += y.passed
            x.ended += y.ended
            x.times.update(y.times)
            for k, to in y.next.items():
                if k in x.next:
                    todo.append((x.next[k], to))
                else:
                    x.next[k] = to
                    grown.append(a)
        return grown

    def _merge_all(self) -> None:
        """In turn every state below the kept ones is merged with the first of them that it agrees with, or kept."""
        kept, known = [0], {0}
        todo = deque((0, k) for k in sorted(self.states[0].next, key=str))
        while todo:
            at, k = todo.popleft()
            state = self.states[at].next[k]
            if state in known:
                continue
            same = next((r for r in kept if self._compatible(r, state)), None)
            if same is None:
                kept.append(state)
                known.add(state)
                grown = [state]
            else:
                self.states[at].next[k] = same
                grown = [g for g in self._fold(same, state) if g in known]
            todo += [(g, s) for g in dict.fromkeys(grown) for s in sorted(self.states[g].next, key=str)]
        place = {r: i for i, r in enumerate(kept)}
        self.states = [self.states[r] for r in kept]
        for s in self.states:
            s.next = {k: place[v] for k, v in s.next.items()}

    def bits(self, value: str) -> float:
        """log2 probability of a value of known characters, its end included. A class gives its characters equal parts."""
        ways, total = {0: 1.0}, 0.0
        for c in value:
            ahead: dict[int, float] = {}
            for at, p in ways.items():
                s = self.states[at]
                for k in STEPS[c]:
                    n = s.times.get(k)
                    if n:
                        to = s.next[k]
                        ahead[to] = ahead.get(to, 0.0) + p * n / s.passed / (1 if k == c else len(CLASSES[k]))
            mass = sum(ahead.values())
            if mass < FLOOR:
                ahead, mass = {at: p * FLOOR for at, p in ways.items()}, FLOOR
            total += math.log2(mass)
            ways = {at: p / mass for at, p in ahead.items()}
        end = sum(p * (self.states[at].ended / self.states[at].passed or FLOOR / self.states[at].passed) for at, p in ways.items())
        return total + math.log2(end)


def plain_bits(value: str, pairs: np.ndarray) -> float:
    """log2 probability of a value between two spaces by pairs of characters."""
    codes = np.frombuffer(f" {value.lower()} ".encode("ascii", "replace"), np.uint8)
    return float(pairs[codes[:-1], codes[1:]].sum())


GATHERED = "value string, n long"


def _gather(docs: DataFrame) -> DataFrame:
    """Labelled values, each once in a task, and how often each pair of characters occurs (its number, as text, after a space):
    lower case, other characters than ASCII as one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lower = np.zeros(1 << 14, np.int64), np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        lower[128:] = 126
        for block in blocks(batches):
            b = lower[raw_bytes(block.column("text"))[0]].astype(np.uint16)
            held += np.bincount(b[:-1] * 128 + b[1:], minlength=1 << 14)
            values = set()
            for text in block.column("text").to_pylist():
                values.update(ASSIGN.match(text, a)[2] if k == 0 else text[a:b] for a, k, b in base_spans(text))
            values = list({v[:LONGEST_VALUE] for v in values})
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(np.ones(len(values), np.int64))], names=["value", "n"])
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([f" {k}" for k in own], pa.string()), pa.array(held[own])], names=["value", "n"])

    return id_text(docs).mapInArrow(read, GATHERED).groupBy("value").agg(F.sum("n").alias("n"))


@dataclass
class SecretModel:
    automaton: Automaton | None
    #: log2 probability of each character after another.
    pairs: np.ndarray
    told: dict[str, bool] = field(default_factory=dict)

    def keep(self, kind: int, value: str) -> bool:
        """Base spans stay; a candidate stays if its format is likely enough."""
        if kind < OTHER:
            return True
        if value not in self.told:
            if len(self.told) >= REMEMBERED:
                self.told.clear()
            self.told[value] = self.automaton is not None and self.automaton.bits(value) - plain_bits(value, self.pairs) >= THRESHOLD
        return self.told[value]


def learn(docs: DataFrame) -> SecretModel:
    """The automaton from at most SAMPLE distinct labelled values, in the order of a hash (none if there are none), and the pairs
    of characters of all texts. A digit after a digit is never rarer than one of eleven things in plain text: numbers of any
    length are written there, however few the corpus has."""
    gathered = stored(_gather(docs), "labelled")
    chosen = gathered.filter("value not like ' %'").orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()
    sample = sorted(r["value"] for r in chosen)
    counts = np.full(1 << 14, 0.5)
    for r in gathered.filter("value like ' %'").collect():  # at most 2 ** 14
        counts[int(r["value"])] += r["n"]
    counts = counts.reshape(128, 128)
    pairs = np.log2(counts / counts.sum(axis=1, keepdims=True))
    pairs[48:58, 48:58] = np.maximum(pairs[48:58, 48:58], -math.log2(11))
    return SecretModel(Automaton(sample) if sample else None, pairs)


FOUND = "doc_id long, starts array<int>, kinds array<int>, ends array<int>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, starts, kinds (0 to 2 base rules, 3 by format), ends: all spans of each document, by start, then kind.

    Null and empty texts have none; repeated rows are scanned one by one; a null doc_id is kept. Other columns are not read.
    """
    model = learn(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            spans = [sorted((a, k, b) for a, k, b, v in candidate_spans(t) if model.keep(k, v)) for t in block.column("text").to_pylist()]
            columns = [pa.array([[s[i] for s in own] for own in spans], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=["doc_id", "starts", "kinds", "ends"])

    return id_text(docs).mapInArrow(read, FOUND)


def redacted(docs: DataFrame, model: SecretModel | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced; an n_chars column follows. All rows stay; a null text stays null."""
    model = model or learn(docs)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b in sorted((a, k, b) for a, k, b, v in candidate_spans(text) if model.keep(k, v)):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = pa.array([cut(t) for t in block.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else block.column(c) for c in names], names=names)

    out = docs.mapInArrow(apply, kinds)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*KINDS, "format")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, *spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "starts", "kinds", "ends")), strict=True):
                every = [(k, f"{names[k]}:{a}:{b}") for a, k, b in zip(*spans, strict=True)]
                base = ",".join(s for k, s in every if k < OTHER)
                count = Counter(k for k, _ in every)
                out.append((doc, count[0], count[1], count[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in every), count[OTHER]))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return find_secrets(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
