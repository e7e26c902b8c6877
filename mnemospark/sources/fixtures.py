"""The store's tables derived from the star-schema and text tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import preview
from ..schema import MEMORY_TYPES, NIL, SCOPES, SOURCES

AS_OF = "2024-01-31 00:00:00"
TAGS = ("critical", "decision", "key", "important", "config", "reference", "note", "temporary", "draft")
PROJECT = "00000000-0000-4000-8000-000001000003"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def uid(n: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (n % len(values)).cast("int"))


def _back(days: Column, hours: Column | None = None) -> Column:
    parts = {"days": days.cast("int")} | ({"hours": hours.cast("int")} if hours is not None else {})
    return as_of() - F.make_dt_interval(**parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """The records; if they needn't be ``whole``, without what labels and events tell of them, so that no text goes to these by a join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("src"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # A document of several labels is several records.
    if whole or not labels.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        d = d.join(labels, "doc_id", "left")
    if whole:
        seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").cast("timestamp_ntz").alias("last"), F.count(F.lit(1)).alias("times"))
        d = d.join(seen, "doc_id", "left")
    n = F.col("doc_id")
    created = _back((n * 37) % 240, n % 24)
    return d.select(
        uid(n).alias("id"),
        _pick(MEMORY_TYPES, n).alias("memory_type"),
        F.col("text").alias("content"),
        F.when(n % 20 == 19, None).when(F.col("src") == "src0", F.lit(NIL)).otherwise(uid(F.regexp_extract("src", r"(\d+)", 1).cast("long") + 1000000)).alias("project_id"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", _pick(TAGS, n))).alias("tags"),
        *((F.when(F.col("quality").isNotNull(), F.create_map(F.lit("priority"), F.col("quality").cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),) if whole else ()),
        _pick(SOURCES, n).alias("source"),
        _pick(SCOPES, n).alias("scope"),
        created.alias("created_at"),
        *((F.coalesce("last", created).alias("last_accessed"), F.coalesce("times", F.lit(0)).cast("long").alias("access_count")) if whole else ()),
        (((n * 7) % 100) / 100.0).cast("double").alias("importance"),
        (n % 17 == 0).alias("is_deleted"),
        F.when(n % 17 == 0, _back((n * 13) % 60)).alias("deleted_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    total = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunk_total"))
    return c.join(total, "conv_id").select(
        uid(F.col("conv_id") * 100 + F.col("turn") + 2000000).alias("id"),
        uid(F.col("conv_id") + 3000000).alias("chunk_group_id"),
        F.col("turn").alias("chunk_index"),
        "chunk_total",
        F.lit("conversation").alias("memory_type"),
        F.col("text").alias("content"),
        F.array("role").alias("tags"),
        F.lit(None).cast("string").alias("project_id"),
        F.lit(False).alias("is_deleted"),
        ((F.col("turn") * 13 % 100) / 100.0).alias("importance"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(uid(F.col("vec_id")).alias("id"), "embedding", "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir, whole=False).select("id", "project_id", "memory_type", "tags", preview(F.col("content")).alias("preview"), "importance")
    return embeddings(spark, sf_dir).drop("label").join(m, "id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search request of every vector whose id is divisible by 20: its embedding, the first, middle and last word of an item, and a scope."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[.,]", "")), r"\s+")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 20).alias("qid"), words.alias("w"))
    n = F.size("w")
    b = b.select("qid", F.array_join(F.transform(F.array(F.lit(1), F.floor((n + 1) / 2).cast("int"), n), lambda i: F.element_at("w", i)), " ").alias("words"))
    k = F.floor(F.col("qid") / 20) % 4
    return e.join(b, "qid").select(
        "qid", "q", "words",
        F.when(k == 3, None).when(k == 2, F.lit(NIL)).otherwise(F.lit(PROJECT)).alias("project"),
        ((k == 0) | (k == 2)).alias("include_global"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds of all documents, first and second deletes, and added tags."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src"))
    n = F.col("doc_id")
    created = _back((n * 37) % 240, n % 24)

    def op(rows: DataFrame, kind: str, base: int, value: Column) -> DataFrame:
        return rows.select((n + base).alias("seq"), (created + F.make_dt_interval(days=F.lit(base // 1000000))).alias("ts"), F.lit(kind).alias("op"), uid(n).alias("id"), value.alias("value"))

    out = op(d, "add", 0, F.col("src"))
    out = out.unionByName(op(d.filter(n % 17 == 0), "delete", 1000000, F.lit(None).cast("string")))
    out = out.unionByName(op(d.filter(n % 51 == 0), "delete", 2000000, F.lit(None).cast("string")))
    return out.unionByName(op(d.filter(n % 13 == 0), "tag", 3000000, F.lit("pinned")))
