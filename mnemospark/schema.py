"""Tables of the store and the values their columns may take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIL = "00000000-0000-0000-0000-000000000000"
MEMORY_TYPES = ("conversation", "knowledge", "decision", "preference", "context")
SOURCES = ("user", "system", "inferred", "external")
SCOPES = ("project", "global", "workspace")

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("memory_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("importance", T.FloatType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("last_accessed", T.TimestampNTZType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("project_id", T.StringType()),
        T.StructField("is_deleted", T.BooleanType()),
        T.StructField("deleted_at", T.TimestampNTZType()),
        T.StructField("chunk_group_id", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("chunk_total", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("scope", T.StringType()),
    ]
)

VECTOR = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def with_defaults(memory: Column) -> list[Column]:
    """Columns of a record read from JSON, absent ones filled in."""
    fill = {"memory_type": "conversation", "importance": 0.8, "access_count": 0, "is_deleted": False, "source": "user", "scope": "project"}
    out = []
    for f in MEMORY.fields:
        c = memory[f.name]
        if f.name in fill:
            c = F.coalesce(c, F.lit(fill[f.name]).cast(f.dataType))
        elif f.name == "tags":
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name == "metadata":
            c = F.coalesce(c, F.create_map().cast(f.dataType))
        out.append(c.alias(f.name))
    return out


def checked(column: Column, domain: tuple[str, ...]) -> Column:
    """The value if the domain has it, else null (an unknown source or scope is ignored)."""
    return F.when(column.isin(*domain), column)
