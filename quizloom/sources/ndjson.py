"""Lines of JSON from a stream that may be cut or damaged: what can be read is read, what cannot is kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a run tells, line by line.
MESSAGE = "type string, stage string, detail string, index int, total int"


def lenient(lines: DataFrame, schema: str = MESSAGE, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The lines that are JSON objects of the schema, with its fields in place of `value`, and the others as they are, with the
    reason (blank, not JSON, not an object, other types). One pass each; blank and null lines are no loss but are counted.

    Fields that are missing are null and unknown ones are dropped. A field of another type makes the line bad, not null.
    """
    parsed = F.from_json(value, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_json", parsed)
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    whole = F.try_parse_json(text)
    reason = F.when(text == "", "blank").when(whole.isNull(), "not JSON").when(~F.schema_of_variant(whole).startswith("OBJECT"), "not an object").when(F.col("_json").isNull() | F.col("_json._bad").isNotNull(), "other types")
    rows = rows.withColumn("reason", reason)
    fields = [x.strip().split(" ")[0] for x in schema.split(",")] if "<" not in schema else [f for f in lines.sparkSession.createDataFrame([], schema).columns]
    kept = [c for c in lines.columns if c != value]
    return rows.filter("reason is null").select(*kept, *[F.col(f"_json.{f}").alias(f) for f in fields]), rows.filter("reason is not null").select(*lines.columns, "reason")
