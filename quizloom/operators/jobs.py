"""Facts about captures, jobs and cards: append-only events, and the states that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The states that may follow a state.
JOB = {"queued": ["running"], "running": ["awaiting_user", "succeeded", "failed", "cancelled"], "awaiting_user": [], "succeeded": [], "failed": [], "cancelled": []}
CARD = {"detected": ["extracted"], "extracted": ["needs_review"], "needs_review": ["approved", "rejected"], "approved": ["exported"], "rejected": [], "exported": []}


def facts(events: DataFrame) -> DataFrame:
    """Each event once, however often it was sent: the earliest row of an event_id."""
    order = Window.partitionBy("event_id").orderBy("occurred_at")
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _steps(events: DataFrame, machine: dict[str, list[str]]) -> DataFrame:
    """events (event_id, entity_id, state, occurred_at) with `before`, the state of the entity before, and `allowed`. A state
    that repeats the one before is no step. The first state must be the first of the machine."""
    order = Window.partitionBy("entity_id").orderBy("occurred_at", "event_id")
    rows = facts(events).withColumn("before", F.lag("state").over(order)).filter(~F.col("state").eqNullSafe(F.col("before")))
    start = next(iter(machine))
    pairs = [f"{a}>{b}" for a, following in machine.items() for b in following]
    allowed = F.when(F.col("before").isNull(), F.col("state") == start).otherwise(F.concat_ws(">", "before", "state").isin(*pairs))
    return rows.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def invalid_steps(events: DataFrame, machine: dict[str, list[str]]) -> DataFrame:
    """event_id, entity_id, before and state of steps that the machine does not have."""
    return _steps(events, machine).filter("not allowed").select("event_id", "entity_id", "before", "state")


def states(events: DataFrame) -> DataFrame:
    """entity_id, state and n_events: the latest state of each entity, by time, then event."""
    return facts(events).groupBy("entity_id").agg(F.max_by("state", F.struct("occurred_at", "event_id")).alias("state"), F.count(F.lit(1)).alias("n_events"))
