"""Plumbing that operators share: written intermediate results, Python workers, request batches."""

from __future__ import annotations

import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requests of one batch that are broadcast; larger batches are dealt in blocks.
BATCH = 1000

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder if all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("mnemospark.local.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("mnemospark.local.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/mnemospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _file(spark, path)
    return system.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    where, system = _file(spark, path)
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


class Conflict(RuntimeError):
    """Another writer made the file first."""


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Makes a small file that must not be there yet: it appears whole, and of several writers one succeeds."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, system = _file(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(draft), system.makeQualified(where), never)
    except Exception as e:
        system.delete(draft, False)
        if exists(spark, path):
            raise Conflict(path) from e
        raise


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written, nothing if there is none."""
    where, system = _file(spark, path)
    return time.time() - system.getFileStatus(where).getModificationTime() / 1000 if system.exists(where) else None


def delete(spark: SparkSession, path: str) -> None:
    where, system = _file(spark, path)
    system.delete(where, True)


def mended(df: DataFrame) -> list[tuple[str, int, int]]:
    """The files that a table is read from, with their sizes and times of change."""
    out = []
    for name in sorted(df.inputFiles()):
        where, system = _file(df.sparkSession, name)
        status = system.getFileStatus(where)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables under the shared folder; results that still read them must be written first."""
    where, system = _file(spark, f"{shared_dir(spark)}/mnemospark")
    system.delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="mnemospark-")) / "mnemospark_base.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent).as_posix())
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


#: Bytes a core of what a table's files hold: below the first its rows are spread anew, from the second on they stay as they are.
TINY, SMALL = 8 << 20, 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a small table of few files would keep most idle; others stay as they are, so that no text is shuffled.

    The size is the planner's estimate for the files below.  Between ``TINY`` and ``SMALL`` a job counts the tasks that have rows, without reading the columns.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= SMALL * cores:
        return rows
    if size >= TINY * cores and 2 * rows.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return rows
    return rows.repartition(cores)


def against_requests(rows: DataFrame, requests: DataFrame, condition: Column | Callable[[], Column] | None = None, then: Callable[[DataFrame], DataFrame] = lambda both: both) -> DataFrame:
    """Every row beside every request that meets ``condition``, and what ``then`` makes of it (all that belongs to one request comes to it at once).

    The requests are written, so that they are made once.  A batch of ``BATCH`` at most is broadcast; a larger one
    ``BATCH`` at a time, in as many passes over the rows.  Each pass is a job of its own that writes its outcome, so rows stay where they are,
    plans stay small, and a lost executor costs a part of one pass.
    """
    requests = materialise(requests, "requests")
    on = condition if condition is not None else F.lit(True)
    n = requests.count()  # of Parquet footers
    if n <= BATCH:
        return then(rows.join(F.broadcast(requests), on))
    blocks = -(-n // BATCH)
    block = F.pmod(F.xxhash64(*requests.columns), F.lit(blocks))
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/mnemospark/passes-{uuid.uuid4().hex}"
    for b in range(blocks):
        part = then(rows.join(F.broadcast(requests.filter(block == b)), on))
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)
