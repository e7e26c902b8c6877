"""Project files, JSON export and import, and table folders."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import from_json, to_json
from ..schema import MEMORY


def project_lines(lines: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """``path, project_id, created_at, project_name`` from ``key=value`` lines; a file without the first two is left out."""
    pair = F.split(F.trim(value), "=", 2)
    rows = lines.select(path, F.trim(F.get(pair, F.lit(0))).alias("k"), F.trim(F.get(pair, F.lit(1))).alias("v")).filter(F.col("v").isNotNull())
    named = rows.groupBy(path).agg(
        F.max(F.when(F.col("k").endswith("project_id"), F.col("v"))).alias("project_id"),
        F.max(F.when(F.col("k") == "created_at", F.col("v"))).alias("created_at"),
        F.max(F.when(F.col("k") == "project_name", F.col("v"))).alias("project_name"),
    )
    return named.filter(F.col("project_id").isNotNull() & F.col("created_at").isNotNull())


def read_project_files(spark: SparkSession, path: str) -> DataFrame:
    return project_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


#: The name of a project's file in its root (no dot before it: Spark does not read hidden files).
PROJECT_FILE = "mnemospark.project"


def write_project_file(root: str | Path, project_id: str, created_at: str, name: str | None = None) -> Path:
    """The file that ``read_project_files`` reads."""
    path = Path(root) / PROJECT_FILE
    lines = [f"store_project_id={project_id}", f"created_at={created_at}", *([f"project_name={name}"] if name else [])]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def project_root(folder: str | Path) -> Path:
    """The nearest folder upward that holds a repository, else the folder itself."""
    folder = Path(folder).resolve()
    return next((p for p in (folder, *folder.parents) if (p / ".git").exists()), folder)


def detect_project(folder: str | Path, create: bool = True) -> dict[str, str | None] | None:
    """``project_id, created_at, project_name, root`` of the project that a folder of the driver belongs to; made if it has none and ``create`` is set."""
    root = project_root(folder)
    path = root / PROJECT_FILE
    if not path.exists():
        if not create:
            return None
        write_project_file(root, str(uuid.uuid4()), datetime.now(UTC).isoformat(timespec="seconds"))
    pairs = dict(x for line in path.read_text(encoding="utf-8").splitlines() if len(x := [part.strip() for part in line.split("=", 1)]) == 2)
    key = next((k for k in pairs if k.endswith("project_id")), None)
    if key is None or "created_at" not in pairs:
        raise ValueError(f"{path}: no project id or no time of creation")
    return {"project_id": pairs[key], "created_at": pairs["created_at"], "project_name": pairs.get("project_name"), "root": str(root)}


def write_json(memories: DataFrame, path: str) -> None:
    to_json(memories).select("value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY).parquet(path)
