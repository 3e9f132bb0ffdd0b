"""A corpus of quiz texts made from the columns of `part`, so that the expected cards follow from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One quiz for each part, in a dialect that Spark and DuckDB share: single choice, select all, true/false; no key for
#: every fourth part.
BODY = """concat('1. Which brand is part ', p_name, '?', chr(10), 'A) ', p_brand, chr(10), 'B) Brand#00', chr(10), 'C) Brand#99', chr(10),
'2. Select all that apply to it', chr(10), 'a) Size ', cast(p_size AS string), chr(10), 'b) Size 0', chr(10), 'c) Type ', p_type, chr(10),
'3. Its size is even', chr(10), 'A) True', chr(10), 'B) False', chr(10),
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('Answers:', chr(10), '1. A', chr(10), '2. A, C', chr(10), '3. ', CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END) END)"""


def quizzes(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """doc_id, title and body of a quiz for each part. A part takes a few bytes and its quiz much work, so parts are dealt out
    before anything is made of them: one file of them would be one task. spread: not where the reader deals the quizzes out."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    part = part.repartition("p_partkey") if spread else part
    return part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.expr(BODY).alias("body"), "p_brand", "p_size", "p_type")
