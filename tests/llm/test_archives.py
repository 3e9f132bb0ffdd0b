"""Legacy archives to WARC and back: round trips, archives written by hand, copies, damage."""

import base64
import gzip
import hashlib

import pytest

from quizloom.llm import archives


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


ROWS = [
    (1, "http://a.org/x y", "<p>same</p>"), (7, "http://a.org/2", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "", None), (5, "http://b.org", ""), (6, "dns:c.org", "café\r\n\r\nWARC/1.0\r\n\r\n filedesc://x 日本"),
    (8, "http://d.org", "x" * 300_000), (None, "http://e.org", "alone"), (None, "http://e.org", "<p>same</p>"), (9, "http://f.org", "twice"), (9, "http://f.org", "twice"), (-2, "http://g.org", "\n\n"),
]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_round_trip(spark, tmp_path, broadcast, monkeypatch):
    """Each page is a record; copies refer to the largest page; null html is empty; repeated rows are records of their own."""
    monkeypatch.setattr(archives, "MOST_BROADCAST", broadcast)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'y' as value").repartition(3)
    archives.write_arcs(pages, f"{tmp_path}/arc")
    legacy = archives.read_arcs(spark, f"{tmp_path}/arc").collect()
    assert {r["version"] for r in legacy} == {1, 2} and len(legacy) == len(ROWS) and all(r["error"] is None for r in legacy)
    assert {r["url"] for r in legacy if r["page_id"] in (1, 3, 4)} == {"http://a.org/x%20y", None}
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    records = archives.resolved(archives.stored(archives.read_warcs(spark, f"{tmp_path}/warc"), "records")).collect()
    assert all(r["error"] is None for r in records) and len({r["record_id"] for r in records}) == len(ROWS)
    got = sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in records)
    assert got == sorted(repr((i, len((t or "").encode()), digest((t or "").encode()))) for i, _, t in ROWS)
    kinds = sorted(repr((r["page_id"], r["type"], r["refers_page"])) for r in records)
    assert kinds == sorted(map(repr, [(1, "revisit", 7), (7, "response", None), (3, "revisit", 7), (4, "revisit", 5), (5, "response", None), (6, "response", None), (8, "response", None), (None, "response", None), (None, "revisit", 7), (9, "response", None), (9, "revisit", 9), (-2, "response", None)]))
    assert {r["date"] for r in records} == {"2020-01-01T00:00:00Z"}


def test_no_rows(spark, tmp_path):
    archives.write_arcs(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/arc")
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert archives.resolved(archives.read_warcs(spark, f"{tmp_path}/warc")).collect() == []


def arc(version: int, records: list[tuple[str, bytes]]) -> bytes:
    block = f"{version} 0 Somebody\n{archives.ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else " 200 - - 0 old.arc"
    out = f"filedesc://old.arc 0.0.0.0 19970401120000 text/plain{more} {len(block)}\n".encode() + block
    return out + b"".join(b"\n" + line.encode() + b"\n" + content for line, content in records) + b"\n"


def test_archives_of_others(spark, tmp_path):
    """Both versions, a member for each record, payloads that are not text, records that are no HTTP answers, and damage."""
    picture = b"HTTP/1.0 200 OK\r\nContent-Type: image/gif\r\n\r\n" + bytes(range(256)) * 9
    host = b"19970401 c.org 10.0.0.1"
    one = arc(1, [(f"http://a.org/i.gif 10.0.0.9 19970401120001 image/gif {len(picture)}", picture), (f"dns:c.org 10.0.0.1 19970401120002 text/dns {len(host)}", host)])
    two = arc(2, [(f"http://b.org/i.gif 10.0.0.8 19980401120001 image/gif 200 abc - 120 old.arc {len(picture)}", picture)])
    broken = arc(1, [("http://a.org 10.0.0.9 19970401120001 text/html many", b"x\ny"), (f"http://a.org/i.gif 10.0.0.9 19970401120001 image/gif {len(picture) + 9}", picture)])
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "one.arc").write_bytes(one)
    (folder / "two.arc.gz").write_bytes(gzip.compress(two[:100]) + gzip.compress(two[100:]))
    (folder / "broken.arc").write_bytes(broken)
    (folder / "cut.arc.gz").write_bytes(gzip.compress(two)[:-30])
    (folder / "none.arc").write_bytes(b"")
    rows = {(r["archive"], r["url"]): r for r in archives.read_arcs(spark, str(folder)).collect()}
    gif = rows["one.arc", "http://a.org/i.gif"]
    assert (bytes(gif["content"]), gif["digest"], gif["payload_bytes"], gif["date"], gif["ip"]) == (picture, digest(bytes(range(256)) * 9), 2304, "19970401120001", "10.0.0.9")
    assert (rows["two.arc.gz", "http://b.org/i.gif"]["status"], rows["two.arc.gz", "http://b.org/i.gif"]["version"]) == (200, 2)
    assert sorted(r["error"] for (name, _), r in rows.items() if name == "broken.arc") == ["no header line", "short record"]
    assert any(name == "cut.arc.gz" and r["error"].startswith("unreadable") for (name, _), r in rows.items())
    archives.convert(spark, str(folder), f"{tmp_path}/warc")
    found = {r["uri"]: r for r in archives.read_warcs(spark, f"{tmp_path}/warc").collect()}
    assert {u: (r["type"], r["payload_bytes"], r["error"]) for u, r in found.items()} == {"dns:c.org": ("resource", len(host), None)} | {u: (k, 2304, None) for u, k in zip(sorted(("http://a.org/i.gif", "http://b.org/i.gif"), key=lambda u: found[u]["type"]), ("response", "revisit"), strict=True)}
    assert found["dns:c.org"]["date"] == "1997-04-01T12:00:02Z"


def test_damaged_warc(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: {}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.format(3).encode() + b"abc\r\n\r\njunk\r\n" + head.replace("response", "revisit").format(0).replace("Content", "WARC-Refers-To: <urn:uuid:gone>\r\nContent").encode() + b"\r\n\r\n" + head.format(30).encode() + b"abc")
    records = archives.read_warcs(spark, f"{tmp_path}/a.warc")
    assert [r["error"] for r in records.collect()] == ["digest differs", "no record here", None, "short record"]
    assert [r["refers_page"] for r in archives.resolved(records).filter("type = 'revisit'").collect()] == [None]
