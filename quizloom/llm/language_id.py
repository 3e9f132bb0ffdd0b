"""Operator 10: language identification with error-correcting output codes.

Every language has a codeword; for each of its bits a binary classifier over character n-grams tells the languages with
that bit from the rest. The classifiers are fitted from n-gram sums of all labelled training texts, which Spark adds up by
language. A text gets the language whose codeword has the smallest loss, each bit weighted by how well its classifier does
in training; a text whose second-best codeword is nearly as good is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, raw_bytes, stored

SLOTS = 1 << 14
UNKNOWN = "und"
#: A text is ambiguous if the two best codewords, at full weight of the evidence, are so close in probability.
AMBIGUOUS = 0.02
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: str = "doc_id") -> F.Column:
    """A null doc_id is in training."""
    return F.pmod(F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)), F.lit(4)) == 2


def _slots(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the slot of the n-gram of bytes that ends at each byte; digits and marks count as one. A text
    begins as if after white space."""
    b = _LOWER[data].astype(np.uint32)
    b[(b < 97) | ((b > 122) & (b < 128))] = 32
    starts = at[:-1][at[:-1] < len(b)]
    before = [b]
    for _ in range(2):
        shifted = np.full_like(b, 32)
        shifted[1:] = before[-1][:-1]
        shifted[starts] = 32
        before.append(shifted)
    one, two = b, b + (before[1] << np.uint32(8))
    three = two + (before[2] << np.uint32(16))
    mask = np.uint32(SLOTS - 1)
    return [((g * np.uint32(2654435761)) >> np.uint32(15)) & mask if k else g & mask for k, g in enumerate((one, two, three))]


def _histograms(column: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """n-gram counts, 64 rows at a time."""
    data, at = raw_bytes(column)
    slots = _slots(data, at)
    for begin in range(0, len(at) - 1, 64):
        to = min(len(at) - 1, begin + 64)
        span, size = slice(at[begin], at[to]), np.diff(at[begin : to + 1])
        row = np.repeat(np.arange(to - begin) * SLOTS, size)
        out = np.zeros((to - begin) * SLOTS, np.int64)
        for s in slots:
            out += np.bincount(row + s[span], minlength=len(out))
        yield slice(begin, to), out.reshape(-1, SLOTS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all splits for up to four languages, else columns of a random code, far apart and unlike."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 4:
        columns = [[1 if k == 0 or (c >> (k - 1)) & 1 == 0 else -1 for k in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns, dtype=float).T
    bits = max(15, int(10 * np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        distance = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if distance.min() > far:
            best, far = code, distance.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # slots x bits: log-likelihood ratio of each n-gram
    trust: np.ndarray  # by bit
    scale: float

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language index, score (0 to 1) and ambiguity flag of rows of n-gram counts."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = np.clip((counts @ self.weights) / total * self.scale, -30, 30)
        sharp = np.sort(self._chances(margin), axis=1)
        near = sharp[:, -1] - sharp[:, -2] < AMBIGUOUS if sharp.shape[1] > 1 else np.zeros(len(sharp), bool)
        # a few n-grams say less than many
        p = self._chances(margin * np.minimum(1, np.sqrt(total / 300)))
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best], near

    def _chances(self, margin: np.ndarray) -> np.ndarray:
        """By language, from the weighted losses of its codeword."""
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None, :, :])) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(train: DataFrame) -> LanguageModel | None:
    """Fit from text and lang of all given rows. Rows without either are left out; None if nothing is left.

    What reaches the driver is one vector of SLOTS sums (128 KB) for each language, however many texts there are.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for block in blocks(batches):
            langs = np.array(block.column("lang").to_pylist(), dtype=object)
            for span, counts in _histograms(block.column("text")):
                for lang in set(langs[span]):
                    own = counts[langs[span] == lang]
                    held[lang] = held.get(lang, 0) + own.sum(axis=0)
                    rows[lang] = rows.get(lang, 0) + len(own)
        names = list(held)
        slots = [np.flatnonzero(held[k]) for k in names]
        for k, own in zip(names, slots, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(own) + 1)), pa.array(np.append(own, -1)), pa.array(np.append(held[k][own], rows[k]).astype(np.int64))], names=["lang", "slot", "n"])

    given = train.select("lang", "text").filter("lang is not null and text is not null")
    added = stored(given.mapInArrow(sums, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "grams")
    found = added.toPandas()
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    row = {k: i for i, k in enumerate(languages)}
    counts = np.zeros((len(languages), SLOTS))
    own = found[found["slot"] >= 0]
    counts[own["lang"].map(row).to_numpy(), own["slot"].to_numpy()] = own["n"].to_numpy()
    code = codewords(len(languages))
    rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    weights = np.zeros((SLOTS, code.shape[1]))
    if len(languages) > 1:
        for b in range(code.shape[1]):
            # languages weigh alike on each side, however many texts they have
            plus, minus = rate[code[:, b] > 0].mean(axis=0), rate[code[:, b] < 0].mean(axis=0)
            weights[:, b] = np.log((plus + 1e-7) / (minus + 1e-7))
    margin = rate @ weights
    right = margin * code
    scale = 6.0 / max(1e-9, float(np.median(np.abs(margin)))) if len(languages) > 1 else 1.0
    trust = np.clip(right.min(axis=0) / max(1e-9, float(np.abs(margin).max())), 0.05, None) if len(languages) > 1 else np.ones(1)
    return LanguageModel(languages, code, weights, trust / trust.sum(), scale)


def predict(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the language, the score and the ambiguity of each text, under `names`; columns of docs with these names give
    way. Null texts, and those without a letter, are `und` with score 0 and not ambiguous; so are all texts without a model.
    Languages whose codewords tie go by the alphabet. Repeated rows and null doc_ids stay, each predicted from its text."""
    own = [c for c in docs.columns if c not in names]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lang, score, ambiguous = [UNKNOWN] * block.num_rows, np.zeros(block.num_rows), np.zeros(block.num_rows, bool)
            letters = [t is not None and (any(map(str.isalpha, t))) for t in block.column("text").to_pylist()]
            if model is not None:
                for span, counts in _histograms(block.column("text")):
                    best, p, near = model.decode(counts.astype(np.float64))
                    for k, i in enumerate(range(span.start, span.stop)):
                        if letters[i]:
                            lang[i], score[i], ambiguous[i] = model.languages[best[k]], p[k], near[k]
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in own], pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], names=[*own, *names])

    told = ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "boolean"), strict=True))
    return docs.select(*own).mapInArrow(read, f"{kinds}, {told}")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out, then predict all from their texts."""
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
