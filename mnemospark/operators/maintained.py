"""Statistics that follow changes: partial aggregates of each change, which add up.

A change writes what it adds to every count and sum, with the sign of records that leave, and touches nothing else.  Statistics read the
partials alone: their number is that of the groups, not of the records.  ``FAN`` changes of one size class become one, so there are few to read.
Sums of importance are of whole billionths, so they are exact and changes may come in any order.

Greatest times can't be subtracted.  They have a partial of their own, how many records a project has at each time; a time whose
count has come down to zero counts no more.  Its rows are as many as distinct times, of which ``project_counts`` reads two small columns.

What there is stands in numbered manifests, each made by one writer only, as for the text index.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import create_text, delete, listed, materialise, read_text

FAN = 4
UNIT = 1_000_000_000
BUCKETS = 10

GROUPS = ["memory_type", "project_id", "bucket", "is_deleted"]
SUMS = {"n": "long", "importance": "decimal(38,0)", "rated": "long", "bytes": "long"}
COUNTED = f"memory_type string, project_id string, bucket int, is_deleted boolean, {', '.join(f'{c} {t}' for c, t in SUMS.items())}"
TIMES = "project_id string, last_accessed timestamp_ntz, n long"


class MaintainedStats:
    """Statistics in a folder, of records with ``memory_type, project_id, importance, is_deleted, content, last_accessed``.

    Null types, projects, importances and times are groups and values like others; an empty change changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        """Reads the last manifest."""
        self.version, self.parts = 0, []
        names = [x for x in listed(self.spark, f"{self.path}/manifest") if x.endswith(".json")]
        if names:
            self.parts = json.loads(read_text(self.spark, f"{self.path}/manifest/{max(names)}"))
            self.version = int(max(names).removesuffix(".json"))

    def _commit(self, parts: list[dict]) -> None:
        create_text(self.spark, f"{self.path}/manifest/{self.version + 1:08d}.json", json.dumps(parts))
        self.refresh()

    def _read(self, what: str, schema: str, parts: list[dict] | None = None) -> DataFrame:
        names = [f"{self.path}/{p['name']}/{what}" for p in (self.parts if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _write(self, counted: DataFrame, times: DataFrame) -> dict:
        name = f"parts/{uuid.uuid4().hex}"
        counted.write.parquet(f"{self.path}/{name}/counted")
        times.write.parquet(f"{self.path}/{name}/times")
        rows = sum(self.spark.read.schema(s).parquet(f"{self.path}/{name}/{w}").count() for w, s in (("counted", COUNTED), ("times", TIMES)))  # of Parquet footers
        return {"name": name, "rows": rows}

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Takes records in and out; one that changes is in both, ``removed`` having it as it was."""
        rows = None
        for part, sign in ((added, 1), (removed, -1)):
            if part is not None:
                part = part.select(*GROUPS[:2], "importance", "is_deleted", "last_accessed", F.octet_length("content").alias("bytes"), F.lit(sign).alias("sign"))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return
        rows = materialise(rows, "changes")
        bucket = F.least(F.floor(F.col("importance") * BUCKETS + 1e-9), F.lit(BUCKETS - 1)).cast("int")
        units = F.round(F.col("importance") * UNIT).cast("decimal(38,0)")
        sums = {"n": F.col("sign"), "importance": units * F.col("sign"), "rated": F.when(F.col("importance").isNotNull(), F.col("sign")), "bytes": F.col("bytes") * F.col("sign")}
        counted = rows.withColumn("bucket", bucket).groupBy(*GROUPS).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast(SUMS[c]).alias(c) for c, v in sums.items()))
        times = rows.filter("not is_deleted").groupBy("project_id", "last_accessed").agg(F.sum("sign").alias("n"))
        part = self._write(counted, times.filter("n <> 0"))
        if part["rows"]:
            self._commit([*self.parts, part])
            self._merge()

    def _merge(self) -> None:
        """Adds up the partials of each full size class, smallest first."""
        while True:
            classes: dict[int, list[dict]] = {}
            for p in self.parts:
                classes.setdefault(int(math.log(max(p["rows"], 1), FAN) + 1e-9), []).append(p)
            chosen = next((classes[c] for c in sorted(classes) if len(classes[c]) >= FAN), None)
            if chosen is None:
                return
            part = self._write(self._counted(chosen), self._times(chosen))
            self._commit([*(p for p in self.parts if p not in chosen), part])

    def vacuum(self) -> None:
        """Deletes what the last manifest doesn't name; readers that began before may fail."""
        names = {p["name"].split("/")[1] for p in self.parts}
        for x in listed(self.spark, f"{self.path}/parts"):
            if x not in names:
                delete(self.spark, f"{self.path}/parts/{x}")
        for x in listed(self.spark, f"{self.path}/manifest"):
            if x.endswith(".json") and int(x.removesuffix(".json")) < self.version:
                delete(self.spark, f"{self.path}/manifest/{x}")

    # --- what is read ---

    def _counted(self, parts: list[dict] | None = None) -> DataFrame:
        sums = self._read("counted", COUNTED, parts).groupBy(*GROUPS).agg(*(F.sum(c).cast(t).alias(c) for c, t in SUMS.items()))
        return sums.filter(" or ".join(f"{c} <> 0" for c in SUMS))

    def _times(self, parts: list[dict] | None = None) -> DataFrame:
        return self._read("times", TIMES, parts).groupBy("project_id", "last_accessed").agg(F.sum("n").alias("n")).filter("n <> 0")

    def stats(self) -> DataFrame:
        """As ``store.stats(memories, "corrected")``."""
        live = lambda c: F.sum(F.when(~F.col("is_deleted"), F.col(c)))
        count = lambda v: F.coalesce(v, F.lit(0)).cast("long")
        mean = F.round((live("importance").cast("double") / F.lit(float(UNIT))) / F.nullif(live("rated"), F.lit(0)), 6)
        return self._counted().agg(
            count(F.sum("n")).alias("total"), count(live("n")).alias("active"), count(F.sum(F.when(F.col("is_deleted"), F.col("n")))).alias("deleted"),
            F.sum("bytes").cast("double").alias("storage_usage"), mean.alias("avg_importance"),
        )

    def rollup(self) -> DataFrame:
        """As ``store.rollup``."""
        live = self._counted().filter("not is_deleted").groupBy("memory_type", "project_id").agg(F.sum("n").alias("n")).filter("n <> 0")
        return live.rollup("memory_type", "project_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.grouping_id().alias("level"))

    def project_counts(self) -> DataFrame:
        """As ``store.project_counts``."""
        return self._times().groupBy("project_id").agg(F.sum("n").alias("memory_count"), F.max("last_accessed").alias("last_activity"))

    def importance_histogram(self) -> DataFrame:
        """As ``store.importance_histogram``."""
        return self._counted().filter("not is_deleted").groupBy("bucket", "memory_type").agg(F.sum("n").alias("n")).filter("n <> 0")
