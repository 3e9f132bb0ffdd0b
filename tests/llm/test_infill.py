"""Fill-in-the-middle against a plain reading of the pattern, with chunks so small that most texts are giants."""

import hashlib
import re

import pyarrow as pa
import pytest

from quizloom.llm import infill

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, rate=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_brute_force(spark, docs, rows, chunk, monkeypatch):
    """Cuts inside code points, words and runs of white space; marks; nulls; repeated rows; every text cut or half of them."""
    monkeypatch.setattr(infill, "CHUNK", chunk)
    texts = ["a", " ", "\t\n", " a", "a ", "  é  日本\x0b", "x <P> y", "a<M>", "<", "a <", "<S b c", "\x85   u", "ab  cd\n\nef ", "😀" * 9 + " " + "é" * 11, "word " * 40 + "<P"]
    more = [(100 + k, t) for k, t in enumerate(texts * 3)]
    data = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    for rate in (50, 100):
        out = infill.fill_in_middle(data, rate=rate)
        assert set(docs.columns) - {"n"} <= set(out.columns)
        found = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
        assert sorted(map(repr, found)) == sorted(repr(expected(i, t, rate)) for i, t in [*rows, *more])
        back = out.select("text", infill.restored(out["output"], out["form"]).alias("back")).collect()
        assert all((r["text"] or "") == r["back"] for r in back)


def test_functions_compose(spark):
    """The composed functions of any chunks give what one automaton gives over the whole, whatever state it is entered in."""
    text = " ab  cé \t日 本x ".encode()
    for size in range(1, len(text) + 1):
        chunks = [text[k : k + size] for k in range(0, len(text), size)]
        rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(chunks)], "k int, c binary")
        f = [r["f"] for r in rows.coalesce(1).select("k", infill.arrow_udf(infill.chunk_function, infill.FUNCTION)("c").alias("f")).orderBy("k").collect()]
        state, ends, chars = infill.BLANK, 0, 0
        for x in f:
            state, ends, chars = x["ends"][state], ends + x["counts"][state], chars + x["chars"]
        assert (state, ends + 1, chars) == (infill.BLANK, len(UNITS.findall(text.decode())), len(text.decode()))
        if size > 6:
            break


def test_no_rows(empty):
    assert infill.fill_in_middle(empty).collect() == []


def test_batches_are_scanned_in_pieces(monkeypatch):
    """What numbers the positions of a batch is held for a piece of it at a time; the cuts are those of the whole."""
    seen, leads = [], infill._leads
    monkeypatch.setattr(infill, "_leads", lambda data: (seen.append(len(data)), leads(data))[1])
    texts = pa.array([" ".join(["é", "ab"] * (k % 7)) for k in range(400)] + ["", "x" * 900])
    hashes = [pa.array([(k * p) % 1009 for k in range(len(texts))], pa.int64()) for p in (37, 101)]
    cuts = []
    for piece in (1 << 30, 500):
        monkeypatch.setattr(infill, "PIECE", piece)
        cuts.append([x.to_pylist() for x in infill.cuts_of_texts(iter([(texts, *hashes), (texts[:0], *(h[:0] for h in hashes))]))])
    assert cuts[0] == cuts[1] and cuts[0][1] == [] and len(seen) > 10
    assert seen[0] > 5000 and sorted(seen[1:])[-2] <= 500 and max(seen[1:]) == 900
