"""Runs that tell how far they are: progress rows, then exactly one result or error row."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quizloom.functions.tables import materialized

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
PROGRESS = "seq int, kind string, stage string, step int, total int, rows long, detail string"
MOST_DETAIL = 500


def run(start: DataFrame, stages: list[Stage], sink: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a run over `start` and what its last stage gives (None after an error).

    A progress row comes before each stage and one after it, with the rows it gave, which are counted while they are written
    (DataFrame.observe), not in a pass of their own. The first stage that fails ends the run with an error row; all others end
    with one result row. sink hears of each row as it comes; a sink that fails does not disturb the work.
    """
    spark, rows, at = start.sparkSession, [], start

    def tell(kind: str, stage: str | None, step: int | None, n: int | None = None, detail: str = "") -> None:
        rows.append({"seq": len(rows) + 1, "kind": kind, "stage": stage, "step": step, "total": len(stages), "rows": n, "detail": detail[:MOST_DETAIL]})
        if sink is not None:
            with suppress(Exception):
                sink(rows[-1])

    n = None
    for step, (name, stage) in enumerate(stages, start=1):
        tell("progress", name, step)
        try:
            seen = Observation()
            at = materialized(stage(at).observe(seen, F.count(F.lit(1)).alias("rows")), name)
            n = seen.get["rows"]
        except Exception as e:  # noqa: BLE001 - whatever a stage does, the run ends with one row
            tell("error", name, step, None, f"{type(e).__name__}: {e}")
            return _table(spark, rows), None
        tell("progress", name, step, n)
    tell("result", None, None, n)
    return _table(spark, rows), at


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Two rows for each stage: a few dozen, whatever the data."""
    names = [x.split(" ")[0] for x in PROGRESS.split(", ")]
    return spark.createDataFrame([tuple(r[k] for k in names) for r in rows], PROGRESS)
