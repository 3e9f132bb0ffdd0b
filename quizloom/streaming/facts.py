"""Facts as a stream into tables of their latest states, and streams that are drained into a table.

A batch is told by its id: what it writes goes to a place of that id, and a batch that comes again after a failure writes the
same there or finds it done. So a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quizloom.functions.tables import shared_dir
from quizloom.operators import jobs

FACT = "event_id long, entity_id long, state string, occurred_at timestamp"
STATE = "entity_id long, state string, at struct<occurred_at:timestamp,event_id:long>, n_events long"


class StateTable:
    """Facts under path/facts, and a version of the states for each batch under path/states. The batch ids are those of one
    stream: they grow by one, and a batch is only given again before the next.

    A batch reads its own rows, the facts that came before, and the latest version of the states; the two latest versions stay.
    Facts are laid out by a hash of event_id. An event that is sent again, in this batch or a later one, counts once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self, name: str):  # noqa: ANN202 - a folder of Hadoop's, and its file system
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Batches whose states are written whole."""
        at, store = self._folder("states")
        names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
        whole = [n for n in names if n.startswith("batch=") and store.exists(self._folder(f"states/{n}/_SUCCESS")[0])]
        return sorted(int(n.removeprefix("batch=")) for n in whole)

    def _states(self, batch: int | None) -> DataFrame:
        return self.spark.createDataFrame([], STATE) if batch is None else self.spark.read.schema(STATE).parquet(f"{self.path}/states/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch: rows of event_id, entity_id, state and occurred_at."""
        done = self.versions()
        if batch in done:
            return
        fresh = jobs.facts(rows.select("event_id", "entity_id", "state", "occurred_at")).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int"))
        facts, store = self._folder("facts")
        if store.exists(facts):
            before = self.spark.read.schema(f"{FACT}, batch long, bucket int").parquet(f"{self.path}/facts").filter(F.col("batch") < batch)
            fresh = fresh.join(before.select("bucket", "event_id"), ["bucket", "event_id"], "left_anti")
        fresh.select("event_id", "entity_id", "state", "occurred_at", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/facts/batch={batch}")
        own = self.spark.read.schema(f"{FACT}, bucket int").parquet(f"{self.path}/facts/batch={batch}")
        at = F.struct("occurred_at", "event_id")
        told = own.groupBy("entity_id").agg(F.max_by("state", at).alias("state"), F.max(at).alias("at"), F.count(F.lit(1)).alias("n_events"))
        both = self._states(max((v for v in done if v < batch), default=None)).unionByName(told)
        merged = both.groupBy("entity_id").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"), F.sum("n_events").alias("n_events"))
        merged.write.mode("overwrite").parquet(f"{self.path}/states/batch={batch}")
        for old in done[:-1]:
            folder, store = self._folder(f"states/batch={old}")
            store.delete(folder, True)

    def states(self) -> DataFrame:
        """entity_id, state and n_events after the last batch, as jobs.states() gives them for all events at once."""
        return self._states(max(self.versions(), default=None)).select("entity_id", "state", "n_events")


def drained(rows: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Everything that a stream has until now, as a table, and the query that read it: in append mode its rows, in update mode
    all versions of each row, told apart by `_batch`."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/{number:010d}")

    schema = StructType([*rows.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{at}/rows/none")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows"), query


def into(rows: DataFrame, table: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A stream of facts into a StateTable, until what is there now is read."""
    query = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table).start()
    query.awaitTermination()
    return query
