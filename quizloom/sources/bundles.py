"""Capture bundles: zip archives of a manifest, a semantic snapshot, artifacts and checksums, as a data source.

    spark.dataSource.register(BundleSource)
    rows = spark.read.format("capturebundle").load(folder)

A bundle is verified before any of it is given: one that is damaged or unsafe becomes reject rows alone, a row for each fault.
A reader opens one bundle at a time and never unpacks more than the limits allow. Stores that the reader cannot list are read
through `bundle_rows(spark.read.format("binaryFile")...)`, which makes the same checks.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quizloom.functions.tables import runs_of_key

# Names inside a bundle, the schemas of its parts, and what fields of a manifest may hold.
MANIFEST, SNAPSHOT, CHECKSUMS = "manifest.json", "semantic/question.json", "checksums.sha256"
KNOWN = re.compile(r"manifest\.json|checksums\.sha256|semantic/question\.json|artifacts/viewport\.png|artifacts/region-[A-Za-z0-9_-]+\.png")
MANIFEST_SCHEMA, SNAPSHOT_SCHEMA, PROTOCOL = "extension-capture.v1", "semantic-snapshot.v1", "1.0"
FIELDS = ("captureId", "createdAt", "extension", "page", "captureMode", "captureState", "questionFingerprint", "stateFingerprint", "artifacts", "privacy")
PATTERNS = {"captureId": r"cap_[A-Za-z0-9_-]+", "captureMode": "once|observe|region", "captureState": "question|reveal|unknown", "questionFingerprint": "[a-f0-9]{64}", "stateFingerprint": "[a-f0-9]{64}"}
MIRRORED = ("captureId", "captureState", "questionFingerprint", "stateFingerprint")
PNG = b"\x89PNG\r\n\x1a\n"
# Limits: bytes of a part and of a bundle unpacked, parts of a bundle.
MOST_BYTES, MOST_TOTAL, MOST_PARTS = 20 << 20, 100 << 20, 500

SCHEMA = "bundle string, kind string, name string, media_type string, size long, sha256 string, content binary, body string, reason string"
_ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))])


def _unsafe(info: zipfile.ZipInfo) -> str | None:
    """Why a part must not be unpacked, by its entry alone."""
    name = info.orig_filename
    if not name or name.startswith("/") or "\\" in name or "\0" in name or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
        return "unsafe path"
    if stat.S_ISLNK(info.external_attr >> 16):
        return "symbolic link"
    if info.flag_bits & 1:
        return "encrypted"
    if info.file_size > MOST_BYTES:
        return "too large"
    return None if KNOWN.fullmatch(name) else "unexpected file"


def _object(raw: bytes | None) -> dict | None:
    try:
        found = json.loads(raw.decode()) if raw is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _manifest_faults(manifest: dict | None, parts: dict[str, bytes]) -> Iterator[tuple[str, str]]:
    """What a manifest lacks, and where it disagrees with the parts and their sizes."""
    if manifest is None:
        yield MANIFEST, "not a JSON object"
        return
    if manifest.get("schemaVersion") != MANIFEST_SCHEMA:
        yield MANIFEST, "unknown schema"
    yield from ((MANIFEST, f"no {f}") for f in FIELDS if f not in manifest)
    yield from ((MANIFEST, f"bad {f}") for f, p in PATTERNS.items() if f in manifest and not (isinstance(manifest[f], str) and re.fullmatch(p, manifest[f])))
    extension = manifest.get("extension")
    if "extension" in manifest and not (isinstance(extension, dict) and extension.get("protocolVersion") == PROTOCOL):
        yield MANIFEST, "unknown protocol"
    declared = manifest.get("artifacts")
    if "artifacts" in manifest and not (isinstance(declared, list) and declared and all(isinstance(a, dict) for a in declared)):
        yield MANIFEST, "bad artifacts"
        declared = []
    names = [str(a.get("path")) for a in declared or []]
    yield from ((n, "declared but missing") for n in sorted(set(names) - set(parts)))
    yield from ((n, "not declared") for n in sorted(set(parts) - set(names) - {MANIFEST, CHECKSUMS}))
    for a in declared or []:
        found = parts.get(str(a.get("path")))
        if found is not None and (a.get("bytes") != len(found) or a.get("sha256") != hashlib.sha256(found).hexdigest()):
            yield str(a.get("path")), "not as declared"


def _faults(parts: dict[str, bytes]) -> Iterator[tuple[str, str]]:
    yield from ((n, "missing") for n in (MANIFEST, SNAPSHOT, CHECKSUMS) if n not in parts)
    if MANIFEST in parts:
        manifest = _object(parts[MANIFEST])
        yield from _manifest_faults(manifest, parts)
        if SNAPSHOT in parts:
            snapshot = _object(parts[SNAPSHOT])
            if snapshot is None or snapshot.get("schemaVersion") != SNAPSHOT_SCHEMA:
                yield SNAPSHOT, "unknown schema"
            elif manifest and any(snapshot.get(f) != manifest.get(f) for f in MIRRORED):
                yield SNAPSHOT, "disagrees with the manifest"
    yield from ((n, "not a PNG image") for n in sorted(parts) if n.endswith(".png") and not parts[n].startswith(PNG))
    if CHECKSUMS in parts:
        lines = [x.split(None, 1) for x in parts[CHECKSUMS].decode("utf-8", "replace").splitlines() if x.strip()]
        told = {x[1].lstrip("*"): x[0].lower() for x in lines if len(x) == 2}
        yield from ((n, "no checksum") for n in sorted(set(parts) - set(told) - {CHECKSUMS}))
        yield from ((n, "missing") for n in sorted(set(told) - set(parts)) if n not in (MANIFEST, SNAPSHOT))
        yield from ((n, "checksum differs") for n in sorted(set(told) & set(parts)) if hashlib.sha256(parts[n]).hexdigest() != told[n])


def verified(bundle: str, stream: io.BufferedIOBase) -> list[tuple]:
    """Rows of one bundle: its parts, or what is wrong with it. An unreadable archive has one reject row without a name."""
    reject = lambda name, reason: (bundle, "reject", name, None, None, None, None, None, reason)
    parts, bad = {}, []
    try:
        with zipfile.ZipFile(stream) as archive:
            entries = [i for i in archive.infolist() if not i.is_dir()]
            if len(entries) > MOST_PARTS:
                return [reject(None, "too many files")]
            if sum(i.file_size for i in entries) > MOST_TOTAL:
                return [reject(None, "too large")]
            for info in entries:
                reason = _unsafe(info) or ("duplicate name" if info.filename in parts else None)
                if reason:
                    bad.append(reject(info.orig_filename, reason))
                    continue
                with archive.open(info) as part:
                    raw = part.read(MOST_BYTES + 1)
                if len(raw) > MOST_BYTES:
                    bad.append(reject(info.filename, "too large"))
                parts[info.filename] = raw
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, RuntimeError, zlib.error):
        return [reject(None, "damaged archive")]
    bad += [reject(name, reason) for name, reason in dict.fromkeys(_faults(parts))]
    if bad:
        return bad
    out = []
    for name, raw in sorted(parts.items()):
        kind = "manifest" if name == MANIFEST else "semantic" if name == SNAPSHOT else "checksums" if name == CHECKSUMS else "artifact"
        told = {"manifest": "application/json", "semantic": "application/json", "checksums": "text/plain", "artifact": "image/png"}[kind]
        out.append((bundle, kind, name, told, len(raw), hashlib.sha256(raw).hexdigest(), raw if kind == "artifact" else None, None if kind == "artifact" else raw.decode(), None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Bundles(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


class _BundleReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[InputPartition]:
        """One for each bundle, or bundles of `partitionBytes` together."""
        store, at = _store(self.path)
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not re.search("/[_.]", f.path[len(info.path.rstrip("/")) :])]
        out, size = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if not out or size + f.size > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [_Bundles(x) for x in out] or [_Bundles([])]

    def read(self, partition: _Bundles) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        for path in partition.paths:
            try:
                with store.open_input_file(path) as stream:
                    rows = verified(path.rsplit("/", 1)[-1], stream)
            except OSError as e:
                rows = [(path.rsplit("/", 1)[-1], "reject", None, None, None, None, None, None, f"unreadable: {type(e).__name__}")]
            yield _batch(rows)


class BundleSource(DataSource):
    """Format `capturebundle`. Options: path (a bundle, or a folder of them); partitionBytes, how much of the bundles one task
    reads (0, the default: one bundle)."""

    @classmethod
    def name(cls) -> str:
        return "capturebundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BundleReader(self.options["path"], int(self.options.get("partitionBytes", "0")))


def bundle_rows(files: DataFrame) -> DataFrame:
    """The rows of bundles (path, content), as binary files are read; a file of no bytes does not come from that source."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield _batch(verified(path.as_py().rsplit("/", 1)[-1], io.BytesIO(content.as_py() or b"")))

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def packed(parts: DataFrame) -> DataFrame:
    """key and content: a zip archive for each bundle of parts (bundle, name, content), with checksums of the parts unless they
    bring their own. A bundle is one value in memory, as its limits have it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of_key(batches, "bundle"):
            out, sums = io.BytesIO(), []
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                names = rows.column("name").to_pylist()
                for name, raw in zip(names, rows.column("content").to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(name), raw or b"", zipfile.ZIP_DEFLATED)
                    sums.append(f"{hashlib.sha256(raw or b'').hexdigest()}  {name}\n")
                if CHECKSUMS not in names:
                    archive.writestr(zipfile.ZipInfo(CHECKSUMS), "".join(sums))
            yield pa.RecordBatch.from_arrays([rows.column("bundle").slice(0, 1).combine_chunks(), pa.array([out.getvalue()], pa.binary())], names=["key", "content"])

    rows = parts.select(F.col("bundle").cast("string").alias("bundle"), "name", F.col("content").cast("binary").alias("content"))
    return rows.repartition("bundle").sortWithinPartitions("bundle", "name").mapInArrow(pack, "key string, content binary")


_MANIFEST = "captureId string, createdAt string, captureState string, questionFingerprint string, stateFingerprint string, page struct<origin:string>"


def captures(rows: DataFrame) -> DataFrame:
    """The capture of each accepted bundle, once for each state: capture_id, created_at, state, question_fingerprint,
    state_fingerprint and origin. Of a page only the origin is kept. Equal captures in several bundles are one."""
    m = F.from_json("body", _MANIFEST)
    get = lambda name: m[name]
    told = rows.filter("kind = 'manifest'").select(
        get("captureId").alias("capture_id"), get("createdAt").alias("created_at"), get("captureState").alias("state"), get("questionFingerprint").alias("question_fingerprint"), get("stateFingerprint").alias("state_fingerprint"), m["page"]["origin"].alias("origin")
    )
    return told.dropDuplicates(["capture_id"])


def manifest(capture_id: Column, state: Column, question: Column, fingerprint: Column, created_at: Column, origin: Column, artifacts: Column) -> Column:
    """The JSON of a manifest. artifacts: array of (path, role, mediaType, content)."""
    told = F.transform(
        artifacts, lambda a: F.struct(F.concat(F.lit("art_"), F.substring(F.sha2(a["content"], 256), 1, 12)).alias("artifactId"), a["role"].alias("role"), a["mediaType"].alias("mediaType"), a["path"].alias("path"), F.sha2(a["content"], 256).alias("sha256"), F.octet_length(a["content"]).alias("bytes"))
    )
    true = F.lit(True)
    return F.to_json(
        F.struct(
            F.lit(MANIFEST_SCHEMA).alias("schemaVersion"), capture_id.alias("captureId"), created_at.alias("createdAt"), F.struct(F.lit("firefox").alias("browser"), F.lit("1").alias("extensionVersion"), F.lit(PROTOCOL).alias("protocolVersion")).alias("extension"),
            F.struct(origin.alias("origin"), F.lit("/").alias("path"), F.lit("").alias("title"), F.struct(F.lit(800).alias("width"), F.lit(600).alias("height"), F.lit(1).alias("devicePixelRatio")).alias("viewport")).alias("page"), F.lit("once").alias("captureMode"), state.alias("captureState"),
            question.alias("questionFingerprint"), fingerprint.alias("stateFingerprint"), told.alias("artifacts"), F.struct(*[true.alias(x) for x in ("queryStripped", "fragmentStripped", "sensitiveFieldsExcluded", "scriptsExcluded")]).alias("privacy"),
        )
    )
