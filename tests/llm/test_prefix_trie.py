"""The trie of conversation prefixes against a plain one, over one range of paths and over many."""

import hashlib
import random
import re
import zlib

import pytest

from quizloom.llm import prefix_trie


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h], *mine[h:])
        for d in range(len(path) + 1):
            members, ends = nodes.setdefault(path[:d], (set(), set()))
            members.add(c)
            if d == len(path):
                ends.add(c)
    children, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, (members, _) in nodes.items():
        own_saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in children
    return sorted(
        repr((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())) for p, (m, e) in nodes.items()
    )


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed, n, texts, longest):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-30, 6 * n), n):
        kind = rng.random()
        size = rng.randint(1, longest)
        said = [rng.choice(texts) for _ in range(size)] if kind < 0.6 else [texts[0]] * size if kind < 0.8 else texts[:3]
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 16])
def ranges(spark, request):
    """Paths in one range, or in about so many."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, ranges, seed):
    """Copies of whole conversations, shared heads, long chains, prefixes that end in the middle of others."""
    texts = ["a", "b b", " c\tc  c ", ""]
    rows = conversations(seed, 120, texts, 3 if seed == 1 else 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert found(prefix_trie.prefix_trie(df)) == brute(rows)


def test_odd_rows(spark, ranges):
    """Null conversations, turns, roles and texts; repeated and equal turns; families without their first; clashing columns."""
    rows = [(None, 0, "user", "lost")] + [(40, None, "user", "first"), (40, 0, None, None), (40, 0, "", ""), (40, 1, "user", "x"), (40, 1, "user", "x"), (40, 1, "user", "a y")]
    rows += [(41 + k, 0, "user", "only") for k in range(19)] + [(97, 0, "user", "alone"), (98, 0, "user", "alone"), (-7, 3, "user", "below zero"), (20, 0, "user", "z" * 70_000 + " z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as key", "1 as depth", "'y' as path")
    assert found(prefix_trie.prefix_trie(df)) == brute(rows)
    none = prefix_trie.prefix_trie(df.filter("conv_id < -100"))
    assert none.collect() == []


def test_turnless_only(spark, ranges):
    """Rebuilt conversations without turns are members of the root alone, which is then a leaf."""
    gone = [c for c in range(61, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "own") for c in gone]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = found(prefix_trie.prefix_trie(df))
    assert out == brute(rows) and len(out) == 1


def test_many_copies(spark, ranges, monkeypatch):
    """The ids of a path with many copies pass in chunks of a few."""
    monkeypatch.setattr(prefix_trie, "FLUSH_IDS", 7)
    rows = [(20 * c, k, "user", f"{k}") for c in range(300) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.prefix_trie(df)) == brute(rows)
