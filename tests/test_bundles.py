"""Bundles written, read and refused; the sink that shows all files or none."""

import hashlib
import io
import json
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from quizloom.sources import bundles
from quizloom.sources.bundles import BundleSource
from quizloom.sources.keyed_files import KeyedFiles

IMAGE = bundles.PNG + b"pixels"
HEX = "0123456789abcdef" * 4


def parts(**changes):
    """The parts of a good bundle, with some fields of the manifest changed (None: left out)."""
    snapshot = json.dumps({"schemaVersion": "semantic-snapshot.v1", "captureId": "cap_1", "captureState": "question", "questionFingerprint": HEX, "stateFingerprint": HEX, "nodes": []}).encode()
    told = [{"artifactId": "art_a", "role": role, "mediaType": kind, "path": name, "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)} for role, kind, name, raw in (("semantic-snapshot", "application/json", bundles.SNAPSHOT, snapshot), ("viewport", "image/png", "artifacts/viewport.png", IMAGE))]
    manifest = {"schemaVersion": "extension-capture.v1", "captureId": "cap_1", "createdAt": "2026-01-01T00:00:00Z", "extension": {"protocolVersion": "1.0"}, "page": {"origin": "http://a.org", "path": "/secret"}, "captureMode": "once", "captureState": "question", "questionFingerprint": HEX, "stateFingerprint": HEX, "artifacts": told, "privacy": {}}
    manifest = {k: v for k, v in (manifest | changes).items() if v is not None}
    return {bundles.MANIFEST: json.dumps(manifest).encode(), bundles.SNAPSHOT: snapshot, "artifacts/viewport.png": IMAGE}


def zipped(entries, sums=None, link=None):
    out = io.BytesIO()
    sums = {n: hashlib.sha256(r).hexdigest() for n, r in entries.items()} | (sums or {})
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in entries.items():
            info = zipfile.ZipInfo(name)
            if name == link:
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, raw, zipfile.ZIP_DEFLATED)
        z.writestr(bundles.CHECKSUMS, "".join(f"{h}  {n}\n" for n, h in sums.items()))
    return out.getvalue()


GOOD = parts()
FAULTS = {
    "not_zip": (b"PK not a zip", {(None, "damaged archive")}),
    "empty": (b"", {(None, "damaged archive")}),
    "path": (zipped(GOOD | {"../evil.png": IMAGE}), {("../evil.png", "unsafe path"), ("../evil.png", "missing")}),
    "absolute": (zipped(GOOD | {"/etc/passwd": b"x"}), {("/etc/passwd", "unsafe path"), ("/etc/passwd", "missing")}),
    "link": (zipped(GOOD, link="artifacts/viewport.png"), {("artifacts/viewport.png", "symbolic link"), ("artifacts/viewport.png", "missing"), ("artifacts/viewport.png", "declared but missing")}),
    "hash": (zipped(GOOD, {"artifacts/viewport.png": "0" * 64}), {("artifacts/viewport.png", "checksum differs")}),
    "unlisted": (zipped(GOOD | {"artifacts/region-2.png": IMAGE}), {("artifacts/region-2.png", "not declared")}),
    "script": (zipped(GOOD | {"run.js": b"x"}), {("run.js", "unexpected file"), ("run.js", "missing")}),
    "image": (zipped(GOOD | {"artifacts/viewport.png": b"GIF89a"}), {("artifacts/viewport.png", "not a PNG image"), ("artifacts/viewport.png", "not as declared")}),
    "schema": (zipped(parts(schemaVersion="v0")), {("manifest.json", "unknown schema")}),
    "state": (zipped(parts(captureState="solved")), {("manifest.json", "bad captureState"), ("semantic/question.json", "disagrees with the manifest")}),
    "protocol": (zipped(parts(extension={"protocolVersion": "9"}, privacy=None)), {("manifest.json", "unknown protocol"), ("manifest.json", "no privacy")}),
    "bare": (zipped({}), {("manifest.json", "missing"), ("semantic/question.json", "missing")}),
    "json": (zipped(GOOD | {"manifest.json": b"[1]"}), {("manifest.json", "not a JSON object")}),
}


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "bundles"
    at.mkdir()
    (at / "good.zip").write_bytes(zipped(GOOD))
    for name, (raw, _) in FAULTS.items():
        (at / f"{name}.zip").write_bytes(raw)
    cut = bytearray(zipped(GOOD))
    at_data = cut.index(b"viewport.png") + 14
    cut[at_data : at_data + 4] = b"\xff\xff\xff\xff"
    (at / "torn.zip").write_bytes(bytes(cut))
    return at


def test_source_and_table_agree(spark, folder):
    """One partition for each bundle; a good one gives its parts, another its faults alone; both ways give the same rows."""
    spark.dataSource.register(BundleSource)
    rows = spark.read.format("capturebundle").load(str(folder))
    assert rows.rdd.getNumPartitions() == len(FAULTS) + 2
    found = rows.collect()
    for name, (_, faults) in FAULTS.items():
        mine = [r for r in found if r["bundle"] == f"{name}.zip"]
        assert {(r["name"], r["reason"]) for r in mine} == faults and {r["kind"] for r in mine} == {"reject"}, name
    torn = [r["reason"] for r in found if r["bundle"] == "torn.zip"]
    assert torn and all(x for x in torn)
    good = {r["name"]: r for r in found if r["bundle"] == "good.zip"}
    assert {n: r["kind"] for n, r in good.items()} == {"manifest.json": "manifest", "semantic/question.json": "semantic", "artifacts/viewport.png": "artifact", "checksums.sha256": "checksums"}
    assert bytes(good["artifacts/viewport.png"]["content"]) == IMAGE and json.loads(good["manifest.json"]["body"])["captureId"] == "cap_1"
    files = spark.read.format("binaryFile").load(str(folder))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, bundles.bundle_rows(files).collect())) == sorted(key(r) for r in found if r["bundle"] != "empty.zip")  # Spark gives no files of no bytes
    together = spark.read.format("capturebundle").option("partitionBytes", 1 << 20).load(f"file://{folder}")
    assert together.rdd.getNumPartitions() == 1 and sorted(map(key, together.collect())) == sorted(map(key, found))
    assert [tuple(r) for r in bundles.captures(rows.unionByName(rows)).collect()] == [("cap_1", "2026-01-01T00:00:00Z", "question", HEX, HEX, "http://a.org")]


def test_limits(spark, folder, monkeypatch):
    """A part that unpacks to more than it may is not unpacked, whatever its packed size."""
    monkeypatch.setattr(bundles, "MOST_BYTES", 2000)
    bomb = zipped(GOOD | {"artifacts/region-1.png": bundles.PNG + bytes(1 << 16)})
    assert ("artifacts/region-1.png", "too large") in {(r[2], r[8]) for r in bundles.verified("b", io.BytesIO(bomb))}
    monkeypatch.setattr(bundles, "MOST_TOTAL", 3000)
    assert {(r[2], r[8]) for r in bundles.verified("b", io.BytesIO(bomb))} == {(None, "too large")}
    monkeypatch.setattr(bundles, "MOST_PARTS", 2)
    assert {(r[2], r[8]) for r in bundles.verified("b", io.BytesIO(bomb))} == {(None, "too many files")}


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(BundleSource)
    (tmp_path / "none" / "_pending-1").mkdir(parents=True)
    (tmp_path / "none" / "_pending-1" / "b.zip").write_bytes(zipped(GOOD))
    assert spark.read.format("capturebundle").load(f"{tmp_path}/none").collect() == []


def test_written_and_read_again(spark, tmp_path):
    """Parts of many bundles, packed by the cluster and written by the sink, come back as they were."""
    spark.dataSource.register(BundleSource)
    spark.dataSource.register(KeyedFiles)
    rows = [(f"b{k}", name, bytearray(raw)) for k in range(30) for name, raw in GOOD.items()]
    made = bundles.packed(spark.createDataFrame(rows, "bundle string, name string, content binary").repartition(5))
    made.write.format("keyedfiles").option("suffix", ".zip").mode("append").save(f"{tmp_path}/out")
    found = spark.read.format("capturebundle").load(f"{tmp_path}/out")
    assert found.filter("kind = 'reject'").count() == 0 and found.groupBy("kind").count().filter("count = 30").count() == 4


def test_sink_shows_all_or_nothing(spark, tmp_path):
    """A task that fails leaves what stood there before; so does a key with two rows; a good job replaces files of its keys."""
    spark.dataSource.register(KeyedFiles)
    at = tmp_path / "decks"
    write = lambda df, mode="append": df.write.format("keyedfiles").option("suffix", ".json").mode(mode).save(str(at))
    names = lambda: sorted(p.name for p in at.iterdir() if not p.name.startswith("_pending"))
    decks = spark.range(6).selectExpr("concat('d', id) AS key", "concat('{\"n\":', id, '}') AS content").repartition(3)
    write(decks)
    assert names() == ["_SUCCESS", *[f"d{k}.json" for k in range(6)]] and (at / "d4.json").read_text() == '{"n":4}'
    failing = decks.withColumn("content", F.when(F.col("key") == "d5", F.raise_error(F.lit("lost"))).otherwise("new"))
    for bad in (failing, decks.unionByName(decks), decks.withColumn("key", F.lit("../x")), decks.withColumn("key", F.lit(None).cast("string"))):
        with pytest.raises(Exception):  # noqa: B017, PT011
            write(bad)
        assert names() == ["_SUCCESS", *[f"d{k}.json" for k in range(6)]] and (at / "d4.json").read_text() == '{"n":4}'
    write(decks.filter("key > 'd3'").withColumn("content", F.lit("new")))
    assert (at / "d4.json").read_text() == "new" and (at / "d1.json").read_text() == '{"n":1}'
    write(decks.filter("key > 'd3'"), "overwrite")
    assert names() == ["_SUCCESS", "d4.json", "d5.json"]
