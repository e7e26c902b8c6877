"""Reading and changing the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import MEMORY, NIL, with_defaults


def live(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.col("is_deleted"))


def scan(memories: DataFrame, limit: int, include_deleted: bool = False) -> DataFrame:
    """The first records by id."""
    return (memories if include_deleted else live(memories)).orderBy("id").limit(limit)


def get(memories: DataFrame, key: str) -> DataFrame:
    """One record, deleted or not."""
    return memories.filter(F.col("id") == key)


def by_tag(memories: DataFrame, tag: str, limit: int | None = None, prefix: bool = False) -> DataFrame:
    """Live records with a tag; with ``prefix`` also those with a tag that goes on after a colon."""
    has = F.array_contains("tags", tag)
    if prefix:
        has = has | F.exists("tags", lambda t: F.startswith(t, F.lit(tag + ":")))
    out = live(memories).filter(has)
    return out.orderBy("id").limit(limit) if limit else out


def by_importance(memories: DataFrame, low: float, high: float) -> DataFrame:
    return live(memories).filter(F.col("importance").between(low, high))


def deleted(memories: DataFrame) -> DataFrame:
    return memories.filter("is_deleted")


def by_type(memories: DataFrame, kind: str, limit: int) -> DataFrame:
    return live(memories).filter(F.col("memory_type") == kind).orderBy("id").limit(limit)


def by_project(memories: DataFrame, project: str) -> DataFrame:
    return live(memories).filter(F.col("project_id") == project)


def listed(memories: DataFrame, limit: int, project_only: bool = False, global_only: bool = False, project: str | None = None, mode: str = "parity") -> DataFrame:
    """A scoped listing; parity takes five times the limit before it filters, and so may return fewer."""
    keep = X.list_scope(F.col("project_id"), project_only, global_only, project, NIL)
    rows = scan(memories, limit * 5) if mode == "parity" else live(memories)
    return rows.filter(keep).orderBy("id").limit(limit)


def recent(memories: DataFrame, limit: int = 10) -> DataFrame:
    return live(memories).orderBy(F.desc("last_accessed"), "id").limit(limit)


def without(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("id"), "id", "left_anti")


def missing_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live records that no vector belongs to."""
    return live(memories).join(vectors.select("id"), "id", "left_anti")


def dimension_check(vectors: DataFrame, dimension: int) -> DataFrame:
    """Each vector with whether the store takes it."""
    return vectors.select("id", F.size("embedding").alias("dimension"), (F.size("embedding") == dimension).alias("accepted"))


def accepted(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of the dimension; any other raises."""
    wrong = F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "), F.size("embedding").cast("string")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong.cast("array<float>")))


def stats(memories: DataFrame, mode: str = "parity") -> DataFrame:
    """Counts in one pass.  Parity reports no usage and no average, as the program does."""
    mean = F.lit(0.0) if mode == "parity" else F.round(F.avg(F.when(~F.col("is_deleted"), F.col("importance"))), 6)
    usage = F.lit(0.0) if mode == "parity" else F.sum(F.octet_length("content")).cast("double")
    return memories.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_deleted")).alias("active"), F.count_if("is_deleted").alias("deleted"), usage.alias("storage_usage"), mean.alias("avg_importance"))


def rollup(memories: DataFrame) -> DataFrame:
    """Counts by type, by type and project, and in all."""
    return live(memories).rollup("memory_type", "project_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def project_counts(memories: DataFrame) -> DataFrame:
    return live(memories).groupBy("project_id").agg(F.count(F.lit(1)).alias("memory_count"), F.max("last_accessed").alias("last_activity"))


def importance_histogram(memories: DataFrame, buckets: int = 10) -> DataFrame:
    bucket = F.least(F.floor(F.col("importance") * buckets + 1e-9), F.lit(buckets - 1)).cast("int")
    return live(memories).groupBy(bucket.alias("bucket"), "memory_type").agg(F.count(F.lit(1)).alias("n"))


def _lives(oplog: DataFrame) -> DataFrame:
    """Operations of each record's present life: since its last add, with ``_since``, where its deletes begin to count.

    Operations have a sequence number, so the order of arrival doesn't matter and replays change nothing.  Two aggregations and a join by id, no sorted
    groups; a record with very many operations is a skewed key of the join, which Spark splits.
    """
    once = oplog.dropDuplicates(["id", "seq"])
    start = F.max(F.when(F.col("op") == "add", F.col("seq")))
    retagged = F.coalesce(F.max(F.when(F.col("op") == "replace", F.col("seq"))), F.lit(-1))
    edges = once.groupBy("id").agg(F.coalesce(start, F.lit(-1)).alias("_from"), retagged.alias("_tagged"), F.coalesce(F.max(F.when(F.col("op").isin("add", "recover"), F.col("seq"))), F.lit(-1)).alias("_since"))
    return once.join(edges, "id").filter(F.col("seq") >= F.col("_from"))


def _deletes() -> tuple[Column, Column]:
    """How many deletes count, and when the first of them was."""
    counts = (F.col("op") == "delete") & (F.col("seq") > F.col("_since"))
    return F.count_if(counts), F.min(F.when(counts, F.col("ts")))


def fold(oplog: DataFrame) -> DataFrame:
    """The state that a log of operations leaves: ``id, value, tags, is_deleted, deleted_at``.

    A first delete hides a record, a recovery shows it again, a second delete removes it; an add after that begins anew.
    The value is that of the last add, update or replacement; a replacement is an update that sets the tags, so that earlier added tags no longer count.
    """
    n, at = _deletes()
    return (
        _lives(oplog)
        .groupBy("id")
        .agg(
            F.max_by("value", F.when(F.col("op").isin("add", "update", "replace"), F.col("seq"))).alias("value"),
            F.array_sort(F.collect_set(F.when((F.col("op") == "tag") & (F.col("seq") > F.col("_tagged")), F.col("value")))).alias("tags"),
            n.alias("_n"),
            at.alias("deleted_at"),
        )
        .filter("_n < 2")
        .select("id", "value", "tags", (F.col("_n") == 1).alias("is_deleted"), "deleted_at")
    )


def delete_state(oplog: DataFrame) -> DataFrame:
    """``id, state, deleted_at``: live, soft or hard, as ``fold`` sees it."""
    n, at = _deletes()
    return _lives(oplog).groupBy("id").agg(F.when(n == 0, "live").when(n == 1, "soft").otherwise("hard").alias("state"), at.alias("deleted_at"))


def from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Records from their JSON, with defaults; rows that can't be read are left out."""
    read = rows.select(F.from_json(column, MEMORY, {"mode": "PERMISSIVE"}).alias("m")).filter(F.col("m.id").isNotNull())
    return read.select(*with_defaults(F.col("m")))


def to_json(memories: DataFrame) -> DataFrame:
    return memories.select("id", F.to_json(F.struct(*memories.columns)).alias("value"))


def part_tags(tags: Column, part: Column, total: Column) -> Column:
    """Tags of one part of a split record."""
    return F.concat(
        tags,
        F.array(F.concat(F.lit("part:"), part.cast("string"), F.lit("-"), total.cast("string"))),
        F.when(part == 1, F.array(F.lit("part:first"))).otherwise(F.array().cast("array<string>")),
        F.when(part == total, F.array(F.lit("part:last"))).otherwise(F.array().cast("array<string>")),
    )


def chunk_place(tags: Column) -> Column:
    """(index, total) of a part, from its tag."""
    tag = F.get(F.filter(tags, lambda t: t.rlike(r"^part:\d+-\d+$")), F.lit(0))
    return F.when(tag.isNotNull(), F.struct(F.regexp_extract(tag, r"^part:(\d+)-(\d+)$", 1).cast("long").alias("chunk_index"), F.regexp_extract(tag, r"^part:(\d+)-(\d+)$", 2).cast("long").alias("chunk_total")))


def merge_chunks(memories: DataFrame) -> DataFrame:
    """Live parts of a group joined by line breaks, in order of index; type and tags of the first.

    The merged record is new: it has the group's id, the default importance and no times of its own.
    """
    parts = live(memories).filter(F.col("chunk_group_id").isNotNull())
    part = F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "id", "content", "memory_type", "tags", "project_id")
    g = parts.groupBy(F.col("chunk_group_id").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    first = F.get("p", F.lit(0))
    return g.select("id", F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("content"), first["memory_type"].alias("memory_type"), first["tags"].alias("tags"), first["project_id"].alias("project_id"), F.size("p").alias("parts"), F.lit(0.8).alias("importance"))
