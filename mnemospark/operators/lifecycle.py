"""Importance, retention, deletion, compression and consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..functions import expressions as X
from .store import live


def importance_of(memories: DataFrame, as_of: Column) -> DataFrame:
    score = X.importance(F.col("tags"), F.col("metadata"), F.col("last_accessed"), F.col("access_count"), as_of)
    return live(memories).select("id", "importance", F.round(score, 6).alias("new_importance"))


def changed_importance(memories: DataFrame, as_of: Column) -> DataFrame:
    return importance_of(memories, as_of).filter("importance <> new_importance")


def expired(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    return memories.filter("is_deleted").filter(X.soft_delete_expired(F.col("deleted_at"), as_of, config.soft_delete_days))


def inactive(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    idle = X.days_between(as_of, F.col("last_accessed")) > config.inactive_days
    return live(memories).filter(F.col("importance").between(0.0, config.importance_threshold) & idle)


def cleanup_plan(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """``id, action, reason``.  What is unimportant is only hidden at first, as deletes have two phases."""
    hard = expired(memories, as_of, config).select("id", F.lit("hard").alias("action"), F.lit("expired").alias("reason"))
    soft = inactive(memories, as_of, config).select("id", F.lit("soft").alias("action"), F.lit("low_importance").alias("reason"))
    return hard.unionByName(soft)


def hard_delete_candidates(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    return expired(memories, as_of, config).select("id").union(inactive(memories, as_of, config).select("id")).distinct()


def delete_audit(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    """One row for each purge, with the digest of what went."""
    plan = cleanup_plan(memories, as_of, config)
    return memories.select("id", F.sha2(F.col("content"), 256).alias("content_sha256"), "memory_type").join(plan, "id").select("id", "reason", "action", "memory_type", "content_sha256")


def recoverable(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    return memories.filter("is_deleted").filter(X.days_between(as_of, F.col("deleted_at")) <= config.soft_delete_days)


def evict(memories: DataFrame, usage: float, batch: int = 50, thresholds: tuple[float, ...] = (0.1, 0.2, 0.3), limit: float = 0.95) -> DataFrame:
    """The next batch to go under storage pressure: of the first threshold that any record is under."""
    rows = live(memories).select("id", "importance", reduce(lambda rest, t: F.when(F.col("importance") < t[1], t[0]).otherwise(rest), list(enumerate(thresholds))[::-1], F.lit(None)).alias("step"))
    if usage <= limit:
        rows = rows.filter(F.lit(False))
    rows = rows.filter("step is not null")
    first = rows.agg(F.min("step").alias("least"))
    # One row holds the least step.
    return rows.join(F.broadcast(first), F.col("step") == F.col("least")).orderBy("importance", "id").limit(batch).select("id", "importance", "step")


def compress_candidates(memories: DataFrame, as_of: Column, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    old = X.days_between(as_of, F.col("created_at")) > 7
    fresh = ~F.array_contains("tags", "compressed")
    return live(memories).filter((F.col("importance") < config.low_importance) & old & F.col("memory_type").isin("conversation", "knowledge") & fresh)


def compress(parts: DataFrame, group: str, order: str) -> DataFrame:
    """One row for each group: ids, decisions and conclusions (texts that mention one), clamped mean importance, lengths.

    The summary itself is a model's and not made here; ``ratio`` is of what is kept to what there was.  A group is a conversation: its
    texts that are kept meet in one row.
    """
    decision, conclusion = X.mentions(F.col("content"), X.DECISION_WORDS), X.mentions(F.col("content"), X.CONCLUSION_WORDS)
    kept = decision | conclusion
    texts = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(order, "id", "content")))), lambda x: x["content"])
    return parts.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda x: x["id"]), ",").alias("original_ids"),
        texts(decision).alias("decisions"),
        texts(conclusion).alias("conclusions"),
        F.round(F.least(F.greatest(F.avg("importance"), F.lit(0.3)), F.lit(0.7)), 6).alias("importance"),
        F.round(F.sum(F.when(kept, F.char_length("content")).otherwise(0)) / F.sum(F.char_length("content")), 6).alias("ratio"),
    )


def consolidation_gate(memories: DataFrame, as_of: Column, last_run: Column, min_age_hours: int = 168, min_rows: int = 20, interval_hours: int = 24) -> DataFrame:
    """``project_id, n, due``: whether a project's old records are consolidated now."""
    old = live(memories).filter(X.hours_between(as_of, F.col("created_at")) > min_age_hours)
    due = (F.count(F.lit(1)) >= min_rows) & (X.hours_between(as_of, last_run) >= interval_hours)
    return old.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), due.alias("due"))


def active_projects(projects: DataFrame) -> DataFrame:
    """The project last activated, of a table (project_id, activated_at)."""
    return projects.orderBy(F.desc("activated_at"), "project_id").limit(1)
