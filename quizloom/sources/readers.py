"""Files as documents: text and pages, word tables, images, capability profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 20 << 20
TEXT, PAGE = ("txt", "md"), ("html", "htm")
IMAGE = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff", "pgm", "ppm")
WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def intake(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, kind (text, page, image), body, content and reject of every file: its suffix must be known, its size
    under MOST_BYTES, and text must be UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*TEXT), "text").when(suffix.isin(*PAGE), "page").when(suffix.isin(*IMAGE), "image")
    rows = files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content", kind.alias("kind"))
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    reject = F.when(F.col("kind").isNull(), "unsupported file type").when(F.col("length") > MOST_BYTES, "file too large").when((F.col("kind") != "image") & ~readable, "not UTF-8")
    return rows.withColumn("reject", reject).withColumn("body", F.when(F.col("reject").isNull() & (F.col("kind") != "image"), F.col("content").cast("string"))).drop("length")


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of tab-separated files, quotes as they are; doc_id is the file."""
    rows = spark.read.schema(WORDS).option("sep", "\t").option("quote", "").option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("doc_id", F.xxhash64(F.input_file_name()))


def capabilities(spark: SparkSession, path: str | None) -> list[str]:
    """Declared capabilities of a target profile; a missing or malformed one declares single choice only."""
    closed = ["mcq.single"]
    if not path:
        return closed
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "capabilities array<string>").alias("p")).select("p.capabilities").take(1)
    found = rows[0]["capabilities"] if rows else None
    return list(found) if found else closed
