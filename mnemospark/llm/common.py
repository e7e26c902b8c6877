"""Shared plumbing: reading tables, and Arrow functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..runtime import materialise, shared_dir, ship

__all__ = ["arrow_map", "materialise", "shared_dir", "ship", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
