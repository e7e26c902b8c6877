"""The state of records kept while operations arrive: a keyed fold, with timers that end what was hidden too long.

``store.fold`` reads a whole log; this keeps each record's fold as state and emits the records that a batch touches.  An
operation counts by its number, not by when it arrives, so any division into batches and any replay give the batch fold.  A hidden
record has an event-time timer: once the watermark is past its time it is emitted as gone, without a scan of any table.

A record's state is its last value, its tags, and the deletes since its last add, so it doesn't grow with its updates.  Records of one hash
bucket share a state and a timer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship, shared_dir

DAY_MS = 86_400_000
#: Hidden records go once more than this many whole days have passed.
KEPT_DAYS = 30
#: Groups of records that share a state.
BUCKETS = 1 << 11

EMITTED = "id string, value string, tags array<string>, is_deleted boolean, deleted_at long, state string"
NEW = {"add": -1, "recover": -1, "retag": -1, "at": -1, "value": None, "tags": {}, "deletes": {}, "expired": False}


def apply(s: dict, seq: int, ts: int, op: str, value: str | None) -> None:
    """One operation; ``ts`` in microseconds.  What an add leaves behind stays out, whichever arrives first."""
    if seq < s["add"]:
        return
    if op == "add":
        s.update(add=seq, expired=False)
        s["tags"] = {t: n for t, n in s["tags"].items() if n >= seq}
        s["deletes"] = {k: v for k, v in s["deletes"].items() if int(k) > seq}
        if s["at"] < seq:
            s["at"], s["value"] = -1, None
    if op in ("add", "update", "replace") and seq > s["at"]:
        s["at"], s["value"] = seq, value
    if op == "replace":
        s["retag"] = max(s["retag"], seq)
    elif op == "recover":
        s["recover"] = max(s["recover"], seq)
    elif op == "tag" and value is not None:
        s["tags"][value] = max(s["tags"].get(value, -1), seq)
    elif op == "delete":
        s["deletes"][str(seq)] = ts


def outcome(s: dict) -> tuple[str, int | None]:
    """``live``, ``soft`` (and since when, in microseconds) or ``gone``."""
    since = max(s["add"], s["recover"])
    counted = [ts for seq, ts in s["deletes"].items() if int(seq) > since]
    if s["expired"] or len(counted) > 1:
        return "gone", min(counted, default=None)
    return ("soft", counted[0]) if counted else ("live", None)


def row_of(key: str, s: dict) -> tuple:
    state, at = outcome(s)
    return key, s["value"], sorted(t for t, seq in s["tags"].items() if seq > s["retag"]), state == "soft", at, state


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "value", "tags", "is_deleted", "deleted_at", "state"])
    return out.astype({"deleted_at": "Int64"})


def emitted(key: str, s: dict) -> pd.DataFrame:
    return frame([row_of(key, s)])


def due(s: dict, days: int) -> int | None:
    """When a hidden record goes, in milliseconds."""
    what, at = outcome(s)
    return at // 1000 + (days + 1) * DAY_MS if what == "soft" else None


def _folder(days: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        records = json.loads(state.get[0]) if state.exists else {}
        now, touched = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for part in parts:
                for own, seq, us, op, value in zip(part["id"], part["seq"], part["us"], part["op"], part["value"], strict=True):
                    s = records.get(own)
                    if s is None:
                        s = records[own] = {**NEW, "tags": {}, "deletes": {}}
                    apply(s, int(seq), int(us), op, value)
                    touched.add(own)
        # The bucket's timer is that of the first of its records to go.
        first = None
        for own, s in records.items():
            end = due(s, days)
            if end is not None and end <= now:
                s["expired"] = True
                touched.add(own)
            elif end is not None:
                first = end if first is None else min(first, end)
        state.update((json.dumps(records),))
        if first is not None:
            state.setTimeoutTimestamp(first)
        if touched:
            yield frame([row_of(own, records[own]) for own in sorted(touched)])

    return run


def folding(operations: DataFrame, late: str, days: int = KEPT_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """A stream of operations (seq, ts, op, id, value) as a stream of records as they become: ``id, value, tags, is_deleted, deleted_at, state``.

    Operations that are ``late`` behind the newest are left out by Spark.  Null numbers and ids are no operations.  State is kept for ``buckets`` of records, by a hash
    of the id, since a call into Python for each record costs far more than its fold; the number must stay the same for a checkpoint.
    """
    ship(operations.sparkSession)
    rows = operations.filter("seq is not null and id is not null").select("id", "seq", "op", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("us", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).withWatermark("ts", late)
    return rows.groupBy("bucket").applyInPandasWithState(_folder(days), EMITTED, "state string", "update", GroupStateTimeout.EventTimeTimeout)


def keep(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what ``folding`` emits; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def current(spark: SparkSession, out: str, gone: bool = False) -> DataFrame:
    """The last state of each record; of those that are gone only if asked for."""
    rows = spark.read.schema(f"{EMITTED}, batch long").option("basePath", out).parquet(out)
    last = rows.groupBy("id").agg(F.max_by(F.struct("value", "tags", "is_deleted", F.timestamp_micros("deleted_at").alias("deleted_at"), "state"), "batch").alias("r")).select("id", "r.*")
    return last if gone else last.filter("state <> 'gone'").drop("state")


def folded(operations: DataFrame, late: str = "3650 days", files: int = 4, days: int = KEPT_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """A table of operations run through the stream, a file a batch, in whatever order."""
    spark = operations.sparkSession
    base = f"{shared_dir(spark)}/mnemospark/folding-{uuid.uuid4().hex}"
    operations.repartition(files).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(operations.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    keep(folding(stream, late, days, buckets), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return current(spark, f"{base}/out")
