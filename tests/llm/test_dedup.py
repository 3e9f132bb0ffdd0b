"""Repeated passages and near duplicates against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quizloom.llm import common, near_dedup, substring_dedup
from quizloom.llm.common import Words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words_are_those_of_the_pattern(rows):
    texts = [t for _, t in rows]
    for lower in (False, True):
        w = Words(pa.array(texts, pa.string()), lower)
        data = w.data.tobytes()
        got = [data[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
        want = [SPLIT.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        assert w.count.tolist() == [len(x) for x in want] and got == [x for v in want for x in v]
        flat = [x for v in want for x in v]
        hashes = dict(zip(flat, w.hash.tolist(), strict=True))
        assert len(set(hashes.values())) == len(hashes) and [hashes[x] for x in flat] == w.hash.tolist()


def brute_repeats(spark, rows, window=20, old=()):
    """(doc_id, n_words, n_removed, digest, text) of every row, sorted as text. old: rows that come before those with larger ids."""
    every = [(i, t, False) for i, t in rows] + [(i, t, True) for i, t in old]
    frame = spark.createDataFrame([(k, i, t or "") for k, (i, t, _) in enumerate(every)], "k int, i long, t string")
    place = dict(frame.selectExpr("k", f"xxhash64(coalesce(i, {common.NO_ID}), t)").collect())
    seen, out = set(), []
    for k in sorted(place, key=lambda k: (every[k][0] is not None, every[k][0] or 0, place[k])):
        i, t, is_old = every[k]
        words = SPLIT.findall(t or "")
        gone = [False] * len(words)
        for n in range(len(words) - window + 1):
            own = tuple(words[n : n + window])
            if own in seen:
                gone[n : n + window] = [True] * window
            seen.add(own)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        if not is_old:
            out.append(repr((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)))
    return sorted(out)


def test_repeats(spark, docs, rows, empty):
    got = sorted(repr(tuple(r)) for r in substring_dedup.remove_repeats(docs, with_text=True).collect())
    assert got == brute_repeats(spark, rows)
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_repeats_of_few_words(spark):
    """Ids repeat, are null, and have texts of different lengths."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += rows[:5]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_repeats(spark, rows)


def test_an_index_is_taken_up_again(spark, tmp_path):
    rng = random.Random(6)
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(80)] for _ in range(30)]
    old = [(i, " ".join(t)) for i, t in enumerate(texts[:20])]
    new = [(100 + i, " ".join(texts[i][10:70] + texts[20 + i])) for i in range(8)] + [(200, " ".join(texts[21])), (-1, " ".join(texts[2]))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    substring_dedup.remove_repeats(frame(old), index=substring_dedup.FingerprintIndex(spark, 7, path=str(tmp_path))).count()
    index = substring_dedup.FingerprintIndex.opened(spark, str(tmp_path))
    assert len(index.runs) < 4
    got = substring_dedup.remove_repeats(frame(new), with_text=True, index=index, history=frame(old)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_repeats(spark, new, old=old)


def brute_near(rows, percent=75):
    """(doc_id, n_shingles, component_id, kept) of every row, sorted as text."""
    sets = []
    for _, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((i, len(sets[k]), low, low == i))
    return sorted(map(repr, out))


def check_near(df, rows):
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == brute_near(rows)


def test_near_duplicates(docs, rows, empty):
    check_near(docs, rows)
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_duplicates_in_one_large_group(spark):
    """Versions of one text, many of them linked only through others."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_a_bucket_of_unlike_members(spark, monkeypatch):
    """Texts that share half of their words, in several blocks, with repeated and null ids; few are near copies."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(300):
        words = [*base, *(f"z{rng.randint(0, 10**6)}" for _ in range(30))]
        rows.append((i % 250, " ".join(words)))
        if i % 10 == 0:
            rows.append((None if i % 20 else i + 1000, " ".join([*words[:-2], "other", "end"])))
            rows.append((i % 250, " ".join(words)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_texts_of_classes_alone_stay_where_they_are(spark, monkeypatch):
    """Of many unlike texts only those that may share a bucket, and few others, are joined with their classes."""
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(3000)] + [(5000 + 2 * i + e, " ".join(f"k{i}x{j}" for j in range(40 + e))) for i in range(5) for e in (0, 1)]
    found = {}
    plain = near_dedup._screened

    def screened(df, column, keys):
        out = plain(df, column, keys)
        found.setdefault(column, (out.count(), {r[0] for r in out.select(column).collect()}, {r[0] for r in keys.collect()}))
        return out

    monkeypatch.setattr(near_dedup, "_screened", screened)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got if not r["kept"]} == {(5001 + 2 * i, 5000 + 2 * i) for i in range(5)}
    assert {"doc_id", "node"} <= set(found)
    for n, there, keys in found.values():
        assert keys <= there and n < 600


def test_a_screen_loses_nothing(spark):
    keys = spark.range(-500, 4000, 9).select(F.col("id").alias("node"))
    got = [r["id"] for r in near_dedup._screened(spark.range(-5000, 40000), "id", keys).collect()]
    assert set(range(-500, 4000, 9)) <= set(got) and len(got) == len(set(got)) < 4000
    assert near_dedup._screened(spark.range(50), "id", keys.limit(0)).collect() == []


def test_all_pairs_of_small_buckets(spark):
    """Small buckets give all pairs that their sizes allow; components of pairs and of stars are as before."""
    rows = [(n, 100 + n, 1, b) for b, size in ((1, 2), (2, 8), (3, 5)) for n in range(size)] + [(99, 1000, 1, 1)]
    got = near_dedup._small_pairs(spark.createDataFrame(rows, "node long, n_shingles long, band int, bucket long")).collect()
    assert sorted(map(tuple, got)) == list(combinations(range(8), 2))


def test_one_of_each(spark):
    a, b, c = (" ".join(f"{k}{j}" for j in range(40)) for k in "abc")
    rows = [(5, a, "x"), (3, a + " more", "y"), (3, b, "z"), (3, b, "z"), (None, c, "n"), (9, c, "m"), (7, None, "e"), (7, None, "e"), (8, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = sorted(repr((r["doc_id"], r["text"])) for r in near_dedup.one_of_each(docs).collect())
    assert got == sorted(map(repr, [(3, a + " more"), (3, b), (9, c), (7, None), (8, "")]))
    assert near_dedup.one_of_each(docs.limit(0)).collect() == []


def test_pruning_keeps_what_is_similar():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**32, (4000, near_dedup.HASHES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.75, left, left + 1)
    assert near_dedup._pruned(left, right).all()
    assert not near_dedup._pruned(left, left + 1).any()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1080)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in root)
