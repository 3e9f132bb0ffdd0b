"""Operator 12: legacy web archives (ARC, versions 1 and 2) written, read by declared lengths, and converted to WARC.

Archives are written by Spark's text writer, a record for each row, with a record separator that the format itself has: so they
come to be under the committer, on any file system that Spark writes. They are read as binary files; a task unpacks one archive
as a stream and holds one record at a time beside the packed bytes. An archive is as large as the partition that wrote it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import hot_join, shared_dir, stored

#: The record lines of both versions, by their last names; `-` stands for what is not known.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
UNKNOWN = "-"
WARC_END = "\r\n\r\n"
PAGE_HEADER, PAYLOAD_LENGTH = "X-Page-Id", "X-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = re.compile(rb"\r\n" + PAGE_HEADER.encode() + rb": (-?[0-9]+)\r\n")
#: Date of pages that have none.
DATE = "20200101000000"
#: Copies of more payloads than this are not told by a broadcast (some 100 bytes each) but through the shuffle.
MOST_BROADCAST = 100_000
BATCH_BYTES = 4 << 20

ARC_RECORD = "archive string, offset long, version int, url string, ip string, date string, mime string, status int, page_id long, payload_at long, payload_bytes long, digest string, content binary, error string"
WARC_RECORD = "archive string, offset long, record_id string, type string, date string, uri string, refers_to string, page_id long, payload_bytes long, payload_digest string, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _first_of_file() -> Column:
    """True on the row that a task writes first: the lower 33 bits of the id count the rows of a partition."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def _field(c: Column) -> Column:
    """A value of a header line: white space is written as in URLs, null and empty as unknown."""
    for mark in " \t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return F.when(F.length(c) > 0, c).otherwise(UNKNOWN)


def write_arcs(pages: DataFrame, path: str, date: str = DATE, versions: tuple[int, ...] = (1, 2)) -> None:
    """Pages (page_id, url, html) as ARC files, an archive for each partition, in turn of the given versions.

    A record holds an HTTP answer with the page's id and length in its head and the html in UTF-8. Null html counts as empty,
    a null id or url as unknown; repeated rows are records of their own. No rows: no archive.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit(UNKNOWN))
    content = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: "), key, F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body)
    rows = pages.select(_field(F.col("url")).alias("url"), content.alias("content"), F.element_at(F.array(*map(F.lit, versions)), F.spark_partition_id() % len(versions) + 1).alias("version"))
    size = F.octet_length("content")
    line = {1: (F.col("url"), "0.0.0.0", date, "text/html", size), 2: (F.col("url"), "0.0.0.0", date, "text/html", "200", UNKNOWN, UNKNOWN, UNKNOWN, UNKNOWN, size)}
    record = lambda v: F.concat_ws("\n", F.concat_ws(" ", *[x if isinstance(x, Column) else F.lit(x) for x in line[v]]), "content")

    def opening(v: int) -> Column:
        block = f"{v} 0 quizloom\n{ARC_FIELDS[v]}\n"
        more = {1: "", 2: f" 200 {UNKNOWN} {UNKNOWN} {UNKNOWN} {UNKNOWN}"}[v]
        return F.lit(f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more} {len(block)}\n{block}\n")

    of = lambda v: F.concat(F.when(_first_of_file(), opening(v)).otherwise(""), record(v))
    value = F.when(F.col("version") == 1, of(1)).otherwise(of(2))
    rows.select(value.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one ARC: header lines by the version that the archive declares, contents by their declared lengths.
    Lines that are no header are given with an error, once for each run of them; so is a content that ends early."""
    version, at, bad = 1, 0, False
    while line := stream.readline(1 << 16):
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        names = ARC_FIELDS[2 if fields[0].startswith("filedesc:") and len(fields) == 10 else version].split(" ")
        told = dict(zip(names, fields, strict=False))
        length = told.get("Archive-length", "")
        if len(fields) != len(names) or not length.isdecimal() or not re.fullmatch(r"\d{14}", told["Archive-date"]):
            if not bad:
                yield {"offset": begin, "version": version, "error": "no header line"}
            bad = True
            continue
        bad, content = False, stream.read(int(length))
        at += len(content)
        if fields[0].startswith("filedesc:"):
            declared = content.split(b" ", 1)[0]
            version = int(declared) if declared in (b"1", b"2") else version
            continue
        code = told.get("Result-code", "")
        known = {k: told[n] if told[n] != UNKNOWN else None for k, n in (("url", "URL"), ("ip", "IP-address"), ("mime", "Content-type"))}
        yield known | {"offset": begin, "version": version, "date": told["Archive-date"], "status": int(code) if code.isdecimal() else None, "content": content, "error": "short record" if len(content) < int(length) else None}


def _opened(content: bytes) -> io.BufferedIOBase:
    """Packed archives may have a member for each record or one for all."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _batches(files: Iterator[pa.RecordBatch], read: Callable[[io.BufferedIOBase], Iterator[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in files:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name, stream = path.as_py().rsplit("/", 1)[-1], _opened(content.as_py())
            try:
                for row in read(stream):
                    held.append(row | {"archive": name})
                    size += len(row.get("content") or b"") + 200
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            except (OSError, EOFError) as e:
                held.append({"archive": name, "error": f"unreadable: {type(e).__name__}"})
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def _head(content: bytes) -> tuple[int, int | None]:
    """Where the payload of an HTTP answer begins (0 for other contents), and the page id in its head."""
    if not content.startswith(b"HTTP/"):
        return 0, None
    end = content.find(b"\r\n\r\n")
    end = len(content) if end < 0 else end + 4
    found = _PAGE.search(content, 0, end)
    return end, int(found[1]) if found else None


def read_arcs(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """A row for each record of the archives in path, without their version blocks; digest and length are of the payload, which
    is what follows the head of an HTTP answer, or all of another record. What cannot be read is a row with an error."""
    schema = _arrow(ARC_RECORD)

    def read(stream: io.BufferedIOBase) -> Iterator[dict]:
        for row in _records(stream):
            content = row.get("content", b"")
            at, page = _head(content)
            payload = memoryview(content)[at:]
            yield row | {"page_id": page, "payload_at": at, "payload_bytes": len(payload), "digest": base32_sha1(payload), "content": content if contents else None}

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(batches, read, schema), ARC_RECORD)


def _record_id(archive: Column, offset: Column) -> Column:
    """A name-based identifier: the same record of the same archive always has the same."""
    h = F.md5(F.concat_ws(":", archive, offset))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """Archives in `arcs` as WARC files in `warcs`, packed, one for each partition that is read.

    HTTP answers become responses and other records resources. Of equal payloads that of the largest page_id (then of the
    largest identifier; a record without page_id counts as the smallest) stays; the others become revisits of it, which keep
    their head only. Identifiers come from archive and offset, times from the 14 digits, digests from the bytes. Records with
    an error stay behind: read_arcs() gives them. Digests are read first; contents meet the response of their payload by a
    broadcast if few payloads have copies, else by the digest, hot ones in their place.
    """

    def records(contents: bool) -> DataFrame:
        return read_arcs(spark, arcs, contents).filter("error is null").withColumn("record_id", _record_id(F.col("archive"), F.col("offset")))

    best = stored(records(False).groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("best"), F.count(F.lit(1)).alias("_n")), "payloads")
    again = best.filter("_n > 1")
    rows = records(True)
    rows = rows.join(F.broadcast(again.drop("_n")), "digest", "left") if again.count() <= MOST_BROADCAST else hot_join(rows, best, ["digest"])
    revisit, http = F.col("best.record_id") != F.col("record_id"), F.col("payload_at") > 0
    revisit = F.coalesce(revisit, F.lit(False))
    block = F.when(revisit, F.substring("content", F.lit(1), F.col("payload_at").cast("int"))).otherwise(F.col("content"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    date = F.regexp_replace("date", "^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")
    info = "software: quizloom\r\nformat: WARC File Format 1.0\r\n"
    opening = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.lit("warcinfo")), line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("archive"), F.lit(-1)), F.lit(">"))), line("WARC-Date", date),
        line("Content-Type", F.lit("application/warc-fields")), line("Content-Length", F.lit(str(len(info)))), F.lit(f"\r\n{info}{WARC_END}"),
    )
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").when(http, "response").otherwise("resource")), line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", date), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.nullif(F.col("ip"), F.lit("0.0.0.0"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), F.col("best.record_id"), F.lit(">")))), line("WARC-Profile", F.when(revisit, PROFILE)),
        line(PAYLOAD_LENGTH, F.when(revisit, F.col("payload_bytes").cast("string"))), line("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block.cast("string"),
    )
    rows.select(F.concat(F.when(_first_of_file(), opening).otherwise(""), head).alias("value")).write.option("lineSep", WARC_END).option("compression", "gzip").text(warcs)


def _warc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one WARC, without warcinfo, by declared lengths; payloads are measured again and held against their digest."""
    at, bad = 0, False
    while line := stream.readline(1 << 16):
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not bad:
                yield {"offset": begin, "error": "no record here"}
            bad = True
            continue
        bad, head = False, {}
        while (line := stream.readline(1 << 16)).strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.lower()] = value.strip()
        at += len(line)
        length = head.get("content-length", "")
        block = stream.read(int(length)) if length.isdecimal() else b""
        at += len(block)
        kind, declared = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "warcinfo":
            continue
        start, page = _head(block)
        row = {"offset": begin, "type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "date": head.get("warc-date"), "uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "page_id": page}
        if not length.isdecimal() or len(block) < int(length):
            yield row | {"error": "short record" if length.isdecimal() else "no length"}
        elif kind == "revisit":
            size = head.get(PAYLOAD_LENGTH.lower(), "")
            yield row | {"payload_bytes": int(size) if size.isdecimal() else None, "payload_digest": declared}
        else:
            payload = memoryview(block)[start:]
            found = base32_sha1(payload)
            yield row | {"payload_bytes": len(payload), "payload_digest": found, "error": "digest differs" if declared and declared != found else None}


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in path, without contents and warcinfo; what cannot be read is a row with an error."""
    schema = _arrow(WARC_RECORD)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _batches(batches, _warc_records, schema), WARC_RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with refers_page, the page of the record that a revisit refers to; null for others, and for a revisit whose
    target is not among the records. Records are read several times: give a stored table."""
    again = records.filter("refers_to is not null")
    wanted = again.groupBy("refers_to").agg(F.count(F.lit(1)).alias("_n"))
    targets = records.filter("refers_to is null and record_id is not null").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"))
    found = stored(wanted.join(targets.dropDuplicates(["refers_to"]), "refers_to", "left"), "targets")
    return hot_join(again, found, ["refers_to"]).unionByName(records.filter("refers_to is null").withColumn("refers_page", F.lit(None).cast("long")))


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{at}/arc")
    convert(spark, f"{at}/arc", f"{at}/warc")
    records = resolved(stored(read_warcs(spark, f"{at}/warc"), "records"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))
