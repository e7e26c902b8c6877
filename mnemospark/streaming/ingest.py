"""Streams of operations and of accesses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import fold
from ..runtime import shared_dir


def ingest(spark: SparkSession, source: str, schema: StructType, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append arriving operations to the log; the log is folded when it is read.

    Appending is idempotent: a batch that is run again overwrites its own folder.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """What the log's operations come to."""
    return fold(spark.read.parquet(log).drop("batch"))


def accesses(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Accesses by user and window, replayed events counted once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "user_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))


def latest(changes: DataFrame) -> DataFrame:
    """Windows as their last change left them, of a table with the number of each change's batch."""
    last = F.max_by(F.struct("access_count", "last_accessed"), "batch")
    return changes.groupBy("start", "user_id").agg(last.alias("x")).select("start", "user_id", "x.*")


def _replayed(df: DataFrame, name: str) -> tuple[str, str]:
    """A batch table as files for a stream to read, and a folder for what the stream writes."""
    top = f"{shared_dir(df.sparkSession)}/mnemospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{top}/in")
    return f"{top}/in", top


def ingested(log: DataFrame) -> DataFrame:
    """The state after a log of operations has come in as a stream."""
    spark = log.sparkSession
    source, top = _replayed(log, "oplog")
    ingest(spark, source, log.schema, f"{top}/log", f"{top}/checkpoint").awaitTermination()
    return current(spark, f"{top}/log")


def accessed(events: DataFrame, window: str = "1 day") -> DataFrame:
    """``start, user_id, access_count, last_accessed`` after events (event_id, ts, user_id) have come in as a stream."""
    spark = events.sparkSession
    source, top = _replayed(events, "events")
    counted = accesses(spark.readStream.schema(events.schema).parquet(source), window=window)

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select("window.start", "user_id", "access_count", "last_accessed")
        rows.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    # Windows that changed come out of each batch; those behind the watermark leave the state.
    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(f"{top}/out"))
