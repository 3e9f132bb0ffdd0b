"""Operator 3: interleaved documents of text and media.

HTML is parsed into an ordered sequence of text and media references, with positions and captions; references name their
payload by digest, and a join on the digest resolves them. Payloads are kept apart, as 8-bit grey images in Parquet, and
are never moved: what is joined is what was computed from them where they lie.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import blocks, documents, id_text, raw_bytes, stored

WIDTH = 24
UNIT = WIDTH * 24
PAD = 255
DIGEST = "sha256:"

ITEM = "array<struct<pos:int,kind:string,text:string,media:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "table", "br", "figure", "blockquote", "pre", "nav", "header", "footer", "title"}
_MEDIA = {"img", "audio", "video", "source", "embed"}
_HIDDEN = {"script", "style", "template", "noscript"}


class _Sequence(HTMLParser):
    """Text runs between block tags and media references, in document order. A figcaption belongs to all media of its
    figure, before it or after; without one, the alt text is the caption."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figures: list[tuple[int, list[str]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "media": given["src"], "caption": given.get("alt") or None})
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append((len(self.items), []))

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures and words:
                self.figures[-1][1].append(words)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self._captioned(*self.figures.pop())

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def _captioned(self, begin: int, captions: list[str]) -> None:
        for item in self.items[begin:] if captions else []:
            if item["kind"] == "media":
                item["caption"] = " ".join(captions)

    def done(self) -> list[dict]:
        self.close()
        if self.caption:
            self.text += self.caption
        while self.figures:
            self._captioned(*self.figures.pop())
        self.flush()
        return [{"pos": k, **item} for k, item in enumerate(self.items)]


def sequence(source: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(source or "")
    return parser.done()


def interleaved(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and `items`: the ordered sequence of each page. Null and empty pages have none; repeated rows stay."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_html"):
            items = pa.array([sequence(h) for h in block.column("_html").to_pylist()], _ITEM)
            yield pa.RecordBatch.from_arrays([block.column("_key"), items], names=["_key", "items"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("_key"), F.col(column).alias("_html"))
    return rows.mapInArrow(read, f"_key {kind}, items {ITEM}").withColumnRenamed("_key", key)


def resolved(sequences: DataFrame, payloads: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, media, caption, and the columns of `payloads` (one row for each digest) of every media reference; null
    where no payload has the digest. References to one digest may be many: adaptive execution splits such a partition, as
    long as `payloads` is a stored table and not the output of an aggregation by digest."""
    one = sequences.select(F.col(key), F.explode("items").alias("i")).filter("i.kind = 'media'").select(key, "i.pos", "i.media", "i.caption")
    refs = one.withColumn("_digest", F.regexp_replace("media", "^" + DIGEST, ""))
    return refs.join(payloads.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def image(data: bytes) -> bytes:
    """A grey image of WIDTH samples a row, one byte each (portable graymap)."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def samples(stored_image: bytes) -> bytes:
    magic, size, most, rest = stored_image.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("not a whole 8-bit graymap")
    return rest


def feature(data: bytes) -> str:
    """Mean, 16-bin histogram (0 to f, by share) and an 8 x 8 mean hash of the image."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) / len(x)
    shares = "".join(f"{min(15, int(b * 16)):x}" for b in bins)
    grid = x.reshape(-1, 8, 3).sum(axis=2, dtype=np.int64)
    cut = np.linspace(0, len(grid), 9).astype(int)[:-1]
    cells = np.add.reduceat(grid, cut, axis=0) / np.diff(np.append(cut, len(grid)))[:, None]
    bits = "".join("1" if b else "0" for b in (cells > cells.mean()).ravel())
    return f"{x.mean():.3f}:{shares}:{int(bits, 2):016x}"


def payload(text: memoryview | bytes) -> bytes:
    """A text in UTF-8, filled up with bytes 255 to a positive multiple of UNIT."""
    n = len(text)
    return bytes(text) + bytes([PAD]) * (max(UNIT, -(-n // UNIT) * UNIT) - n)


def as_media(docs: DataFrame) -> DataFrame:
    """digest and media: the payload of each document (null text: empty) as an image, named by its digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            media = [image(payload(t)) for t in _texts(block)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return id_text(docs).mapInArrow(write, "digest string, media binary")


def _texts(block: pa.RecordBatch) -> list[memoryview]:
    data, at = raw_bytes(block.column("text"))
    view, at = memoryview(data), at.tolist()
    return [view[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def page(text: str, digest: str) -> str:
    """A document as a page: its lines are paragraphs, and in their middle stands a figure with the payload, whose caption is
    the paragraph before it."""
    lines = [html.escape(" ".join(x.split())) for x in text.split("\n")]
    lines = [x for x in lines if x]
    half = len(lines) // 2
    caption = f"<figcaption>{lines[half - 1]}</figcaption>" if half else ""
    parts = [*(f"<p>{x}</p>" for x in lines[:half]), f'<figure><img src="{DIGEST}{digest}">{caption}</figure>', *(f"<p>{x}</p>" for x in lines[half:])]
    return f"<article>{''.join(parts)}</article>"


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and html of each document (see page); a null text is empty."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = _texts(block)
            pages = [page(bytes(t).decode(), hashlib.sha256(image(payload(t))).hexdigest()) for t in texts]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])

    return id_text(docs).mapInArrow(write, "doc_id long, n_bytes long, html string")


def payload_features(media: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes: sizes, checksums and features. A payload that does not have its
    digest is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media"):
            rows, known = [], set()
            for digest, held in zip(block.column("digest").to_pylist(), block.column("media").to_pylist(), strict=True):
                if digest in known:
                    continue
                known.add(digest)
                if hashlib.sha256(held).hexdigest() != digest:
                    raise ValueError(f"payload {digest} is damaged")
                data = samples(held)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(held), digest, feature(data)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos: the texts and media before the payload in its document; caption_sha256: of its caption (null without one)."""
    docs = documents(spark, sf_dir)
    held = stored(as_media(docs), "media")
    pages = interleaved(as_pages(docs).select(F.struct("doc_id", "n_bytes").alias("document"), "html"), "document")
    found = resolved(pages, stored(payload_features(held), "features"), "document")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos"]
    return found.select("document.doc_id", "document.n_bytes", *names, F.sha2("caption", 256).alias("caption_sha256"))
