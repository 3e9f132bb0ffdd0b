"""Pixels of PNG images of every kind, the ladder of passes, and images through Spark's own source."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom import queries, source_queries
from quizloom.operators import geometry
from quizloom.sources import images, recognise

assert source_queries  # registers its queries


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, depth, colour, rows, interlace=0, palette=None):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace))
    return images.SIGNATURE + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def noise(height, width, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


@pytest.mark.parametrize(("height", "width"), [(1, 1), (7, 5), (3, 200), (250, 40)])
def test_filters(height, width):
    """Narrow images are undone byte by byte, others along diagonals; filters may change from row to row."""
    page = noise(height, width)
    for kind in range(5):
        assert (images.png_pixels(images.png_bytes(page, kind)) == page).all()
    raw = [zlib.decompress(images.png_bytes(page, kind)[41:].split(b"IEND")[0][:-8]) for kind in range(5)]
    size = 1 + 3 * width
    mixed = b"".join(raw[y % 5][y * size : (y + 1) * size] for y in range(height))
    assert (images.png_pixels(png(width, height, 8, 2, mixed)) == page).all()


def test_kinds():
    grey = np.array([[0, 1, 1], [1, 0, 1]])
    for depth in (1, 2, 4):
        bits = "".join(format(v, f"0{depth}b") for v in grey[0]), "".join(format(v, f"0{depth}b") for v in grey[1])
        rows = b"".join(b"\0" + int(b.ljust(16, "0"), 2).to_bytes(2, "big")[: (3 * depth + 7) // 8] for b in bits)
        found = images.png_pixels(png(3, 2, depth, 0, rows))
        assert (found[..., 0] == grey * (255 // ((1 << depth) - 1))).all() and (found[..., 0] == found[..., 2]).all()
        table = bytes([9, 8, 7, 200, 100, 50])
        assert images.png_pixels(png(3, 2, depth, 3, rows, palette=table))[0].tolist() == [[9, 8, 7], [200, 100, 50], [200, 100, 50]]
    assert images.png_pixels(png(1, 1, 8, 3, b"\0\x05", palette=b"abc")) is None
    assert images.png_pixels(png(2, 1, 8, 4, b"\0\x0a\xff\x14\x00"))[0].tolist() == [[10] * 3, [20] * 3]
    assert images.png_pixels(png(1, 1, 8, 6, b"\0\x01\x02\x03\x04"))[0].tolist() == [[1, 2, 3]]
    assert images.png_pixels(png(1, 1, 16, 2, b"\0\x01\xff\x02\xff\x03\xff"))[0].tolist() == [[1, 2, 3]]


def test_interlaced():
    page = noise(11, 13)
    rows = b"".join(b"\0" + page[y, x::dx].tobytes() for x, y0, dx, dy in images.PASSES for y in range(y0, 11, dy) if x < 13)
    assert (images.png_pixels(png(13, 11, 8, 2, rows, 1)) == page).all()
    assert images.png_pixels(png(1, 1, 8, 2, b"\0abc", 1))[0].tolist() == [[97, 98, 99]]


def test_damage():
    """Whatever is cut, turned or claimed: no pixels, no crash, no huge array."""
    good = images.png_bytes(noise(6, 6), images.PAETH)
    for k in range(len(good)):
        assert images.png_pixels(good[:k]) is None
        turned = bytearray(good)
        turned[k] ^= 0x41
        assert images.pixels(bytes(turned)) is None
    assert images.png_pixels(png(1 << 30, 1 << 30, 8, 2, b"")) is None and images.png_pixels(png(0, 1, 8, 2, b"")) is None
    assert images.png_pixels(png(2, 2, 8, 2, b"\0abc")) is None and images.png_pixels(png(1, 1, 8, 2, b"\x07abc")) is None and images.png_pixels(png(1, 1, 4, 2, b"\0abc")) is None


def test_a_page_is_the_same_in_every_format(spark, tmp_path):
    """PNG, portable pixmap, rows of pixels, and files that the JVM decodes."""
    page = noise(24, 30, 3)
    edges = spark.createDataFrame([(k, 3, 90) for k in (1, 2, 3, 4)], "doc_id long, left int, right int")
    contents = [(1, bytearray(images.png_bytes(page, 4))), (2, bytearray(b"P6\n30 24\n255\n" + page.tobytes())), (3, bytearray(b"GIF89a")), (4, None)]
    rows = images.image_rows(spark.createDataFrame(contents, "doc_id long, content binary"), edges).orderBy("doc_id", "y").collect()
    pixels = spark.createDataFrame([(1, x, y, *map(int, page[y, x])) for y in range(24) for x in range(30)], "doc_id long, x int, y int, red int, green int, blue int")
    want = [(r["y"], r["red"], r["green"], r["blue"]) for r in geometry.row_means(pixels, edges).orderBy("y").collect()]
    for doc in (1, 2):
        assert np.allclose([(r["y"], r["red"], r["green"], r["blue"]) for r in rows if r["doc_id"] == doc], want)
    assert {r["doc_id"] for r in rows} == {1, 2}
    (tmp_path / "a.png").write_bytes(images.png_bytes(page, 2))
    bmp = b"".join(page[y, :, ::-1].tobytes() + b"\0" * (-90 % 4) for y in range(23, -1, -1))
    (tmp_path / "b.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(bmp), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 30, 24, 1, 24, 0, len(bmp), 0, 0, 0, 0) + bmp)
    (tmp_path / "c.jpg").write_bytes(b"no image")
    files = images.image_files(spark, str(tmp_path))
    found = images.image_file_rows(files, files.select("doc_id", F.lit(3).alias("left"), F.lit(90).alias("right"))).collect()
    assert len({r["doc_id"] for r in found}) == 2
    assert np.allclose(sorted((r["y"], r["red"]) for r in found), sorted((w[0], w[1]) for w in want for _ in range(2)))


def test_settled_images_are_not_read_again(spark):
    """The calls are counted where they are made: each image once for every pass until one settles it."""
    calls = spark.sparkContext.accumulator(0)

    def read(content, mode):
        calls.add(1)
        if content == b"":
            raise ValueError("nothing there")
        need, text = content.decode().split("|")
        return text if int(need) == mode else "just some words " * mode

    quiz = "1. Q?\nA) x\nB) y"
    rows = [(1, f"3|{quiz}"), (2, f"6|{quiz}"), (3, f"4|{quiz}"), (4, "9|never"), (5, ""), (None, f"3|{quiz}")]
    table = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "doc_id long, content binary").repartition(2)
    kept, log = recognise.ladder(table, read)
    got = {r["doc_id"]: (r["psm"], r["n_calls"], r["n_errors"]) for r in kept.collect()}
    assert got == {1: (3, 1, 0), 2: (6, 2, 0), 3: (4, 3, 0), 4: (6, 3, 0), 5: (3, 3, 3)}
    assert log.filter("doc_id = 5").select("error").distinct().collect()[0][0] == "ValueError: nothing there"
    assert calls.value == 1 + 2 + 3 + 3 + 3


def test_slow_recogniser_is_given_up(spark):
    def read(content, mode):
        import time

        time.sleep(3 if content == b"slow" else 0)
        return "done"

    rows = spark.createDataFrame([(1, bytearray(b"slow")), (2, bytearray(b"x"))], "doc_id long, content binary")
    assert {r["doc_id"]: r["error"] for r in recognise.attempt(rows, read, 3, seconds=0.5).collect()} == {1: "took over 0.5 seconds", 2: None}
    assert recognise.ladder(rows.limit(0), read)[0].collect() == []


@pytest.mark.parametrize(("height", "width"), [(10, 60), (60, 10), (2, 1)])
def test_images_of_one_form_are_unpacked_together(monkeypatch, height, width):
    """every image was unpacked alone, its bytes one by one. Filters differ by image and by row; damaged images are left out."""
    pages = [noise(height, width, seed) for seed in range(60)]
    size, contents = 1 + 3 * width, []
    for k, page in enumerate(pages):
        raw = [zlib.decompress(images.png_bytes(page, kind)[41:].split(b"IEND")[0][:-8]) for kind in range(5)]
        kinds = [[4], [0, 1, 2], [3, 4], [0, 1, 2, 3, 4], [1, 3], [2]][k % 6]
        contents.append(png(width, height, 8, 2, b"".join(raw[kinds[y % len(kinds)]][y * size : (y + 1) * size] for y in range(height))))
    contents[7:7] = [contents[7][:-20], b"GIF89a", b"", png(width, height, 8, 2, b"\x07" * size * height), png(1, 1, 8, 3, b"\0\x05", palette=b"abc"), b"P6\n0 1\n255\n"]
    pages[7:7] = [None] * 6
    contents += [b"P6\n%d %d\n255\n" % (width, height) + page.tobytes() for page in pages[:3]] + [b"P5\n%d %d\n255\n" % (width, height) + pages[0][..., 0].tobytes()]
    pages += [*pages[:3], np.repeat(pages[0][..., :1], 3, axis=2)]
    for most, band in ((images.TOGETHER, images.BAND), (3 * height * width * 10, images.BAND), (images.TOGETHER, 1), (1, 1)):
        monkeypatch.setattr(images, "TOGETHER", most)
        monkeypatch.setattr(images, "BAND", band)
        found = list(images.stacks(enumerate(contents)))
        assert sorted(k for names, _ in found for k in names) == [k for k, page in enumerate(pages) if page is not None]
        assert all((stack[n] == pages[k]).all() for names, stack in found for n, k in enumerate(names))
        assert all(stack.size <= max(most, 3 * height * width) for _, stack in found)
    monkeypatch.undo()
    assert len(list(images.stacks(enumerate(contents)))) == 2


def test_images_are_dealt_out_by_count(spark):
    """packed images take few bytes, so that all pages of a table were read in two tasks, and edges were broadcast."""
    plan = queries.QUERIES["image_row_means"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Broadcast" not in plan, plan
    page = noise(9, 50)
    table = spark.createDataFrame([(k, bytearray(images.png_bytes(page, k % 5))) for k in range(40)], "doc_id long, content binary")
    edges = spark.createDataFrame([(k, k - 3, 2 * k) for k in range(40)], "doc_id long, left int, right int")
    want = {(k, y): tuple(page[y, (left := min(max(0, k - 3), 49)) : max(left + 1, min(2 * k, 50))].mean(axis=0)) for k in range(40) for y in (0, 4, 8)}
    found = images.image_rows(table, edges)
    assert {(r["doc_id"], r["y"]): (r["red"], r["green"], r["blue"]) for r in found.collect()} == want and found.rdd.getNumPartitions() == 12
