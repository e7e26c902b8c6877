"""Upkeep that falls due by event time: keyed timers for recalculation, cleanup and the consolidation gate.

Each key (a project) has three tasks on grids of whole hours: importance every 24 h, cleanup every 12 h, and every 168 h a look at whether
``GATE`` records came since the last consolidation.  A task is first due at the first point of its grid after the key's first record, and a point
is due once the watermark is past it, so what falls due depends on the records' times, not on batches, replays or the clock.

Records are counted in cells of 12 h before they are shuffled, so a hot key sends a row a cell and Arrow batch.  All grid points are edges of
cells: a cell lies on one side of each.  The state of a key is its next points and the counts of weeks to come.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import shared_dir, ship

CELL_US = 12 * 3_600_000_000
#: Cells between two points of each task's grid.
TASKS = {"cleanup": 1, "recalculate": 2, "consolidate": 14}
#: New records that a consolidation waits for.
GATE = 20

DUE = "project string, task string, due long, n long"


def advance(s: dict, cells: dict[int, int], watermark: int, gate: int = GATE) -> list[tuple[str, int, int]]:
    """Takes in counts by cell; the task, the time and the count of records of all points before the watermark (microseconds)."""
    week = TASKS["consolidate"]
    for cell, n in cells.items():
        s["weeks"][str(cell // week)] = s["weeks"].get(str(cell // week), 0) + n
        for task, step in TASKS.items():
            first = (cell // step + 1) * step
            s["next"][task] = min(s["next"].get(task, first), first)
    out = []
    for task, step in TASKS.items():
        while task in s["next"] and s["next"][task] * CELL_US < watermark:
            at = s["next"][task]
            s["next"][task] = at + step
            if task != "consolidate":
                out.append((task, at * CELL_US, 0))
                continue
            s["pending"] += s["weeks"].pop(str(at // week - 1), 0)
            if s["pending"] >= gate:
                out.append((task, at * CELL_US, s["pending"]))
                s["pending"] = 0
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        cell = (rows["us"] // CELL_US).rename("cell")
        yield rows.groupby([rows["project"], cell], dropna=False)["us"].agg(["size", "max"]).reset_index().rename(columns={"size": "n", "max": "us"})


def _timer(gate: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"next": {}, "weeks": {}, "pending": 0}
        cells: dict[int, int] = {}
        if not state.hasTimedOut:
            for part in parts:
                for cell, n in part.groupby("cell")["n"].sum().items():
                    cells[int(cell)] = cells.get(int(cell), 0) + int(n)
        watermark = state.getCurrentWatermarkMs()
        due = advance(s, cells, watermark * 1000, gate)
        state.update((json.dumps(s),))
        # A timer goes off when the watermark is past it.
        state.setTimeoutTimestamp(max(min(s["next"].values()) * CELL_US // 1000, watermark + 1))
        yield pd.DataFrame({"project": [key[0]] * len(due), "task": [d[0] for d in due], "due": [d[1] for d in due], "n": [d[2] for d in due]}).astype({"due": "int64", "n": "int64"})

    return run


def falling_due(records: DataFrame, late: str, gate: int = GATE) -> DataFrame:
    """A stream of new records (project, ts) as a stream of ``project, task, due, n``: times in microseconds, ``n`` the records of a consolidation.

    Records more than ``late`` behind the newest are left out by Spark, those without a time too; a null project is a key like others.
    """
    ship(records.sparkSession)
    rows = records.filter("ts is not null").select(F.col("project").cast("string").alias("project"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    counted = rows.mapInPandas(_cells, "project string, cell long, n long, us long").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return counted.groupBy("project").applyInPandasWithState(_timer(gate), DUE, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def act(stream: DataFrame, actions: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs an action on what falls due of its task: it gets the rows, and the number of the batch, by which it can tell one that is run again."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for task, action in actions.items():
                due = batch.filter(F.col("task") == task)
                if not due.isEmpty():
                    action(due, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def replayed(records: DataFrame, late: str, files: int = 4, gate: int = GATE) -> DataFrame:
    """What falls due while a table of records is replayed through the stream, oldest first, a file a batch."""
    spark: SparkSession = records.sparkSession
    base = f"{shared_dir(spark)}/mnemospark/schedule-{uuid.uuid4().hex}"
    rows = records.select("project", "ts")
    # One file a range of times; files are taken up in the order of their times of change, so each is a write of its own.
    edges = rows.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / files for i in range(1, files)], 1000)).first()[0] if files > 1 else []
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = sorted(set(edges or []))
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows.filter((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high))
        part.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    falling_due(stream, late, gate).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{DUE}, batch long").option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")
