"""Packing and token files against the plain tokenizer."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from quizloom.llm import packing, token_files
from quizloom.llm.tokens import TOKENIZER, encoder


def plain(text):
    t = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_pieces_are_encoded_as_the_whole(rows):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "ll", ".", "!?", "1", "é", " ", "日本", "\r\n", "\x85", "😀", "<|endoftext|>", "_", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for _, t in rows]
    got = encoder(TOKENIZER).encode(pa.array(texts, pa.string()))
    tok = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    assert [np.array(x.ids, "<u4").tobytes() for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)] == got


def test_marks_of_the_vocabulary_are_tokens():
    assert np.frombuffer(encoder(TOKENIZER).encode(pa.array(["hello <|endoftext|> world"]))[0], "<u4").tolist() == plain("hello <|endoftext|> world")[:-1].tolist() == [31373, 220, 50256, 995]


def test_fill_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(60):
        room, counts = rng.randint(1, 40), {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        used = packing.fill(room, counts)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = {k: rng.randint(1, 50) for k in range(1, 64)}
    used = dict.fromkeys(counts, 0)
    windows = 0
    for times, pattern in packing.plan_windows(counts, 64):
        assert sum(k * n for k, n in pattern.items()) <= 64
        windows += times
        for k, n in pattern.items():
            used[k] += times * n
    assert used == counts and windows <= 1.025 * sum(k * n for k, n in counts.items()) / 64 + 1


def test_pack_documents(docs, rows, empty):
    got = packing.pack_documents(docs, 64).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(plain(t))
    assert sum(r["length"] for r in got) == sum(len(x) for v in texts.values() for x in v)
    for r in got:
        ids = texts[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty).collect() == []


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path)
    got = [tuple(r) for r in token_files.digests(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.read_metadata(spark, path).collect()} == {w[:3] for w in want}
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, 3, 6).collect()} == {3, 4, 5, 6}
    token_files.write_tokens(empty, f"{tmp_path}/none")
    assert token_files.digests(spark, f"{tmp_path}/none").collect() == []
