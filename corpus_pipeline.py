"""A training-data pipeline over `documents`: language ID, near-dedup, decontamination, secret scans, packing.

Each stage reads what the one before has written, works on all of it, and returns the columns of documents; the last
returns packed pieces. Stages may be written and read again between any two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import decontaminate, language_id, near_dedup, packing, secrets
from quizloom.llm.common import shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; `und` and ambiguous texts go. The model learns from those not held out. Null and empty
    texts go (no language); repeated rows and null doc_ids stay or go by their text."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    told = language_id.predict(docs, model, ("_lang", "_score", "_ambiguous"))
    return told.filter((F.col("_lang") != language_id.UNKNOWN) & ~F.col("_ambiguous")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates. Rows equal in doc_id and text are one
    document; other rows with equal or null doc_id stand for themselves; texts without words stay."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark segment. Null and empty texts hold none; without a benchmark all stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows. A null text stays null."""
    return secrets.redacted(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null text is empty. No documents: no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: The stages learn models, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{at}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}-{name}")
    return docs
