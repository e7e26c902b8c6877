"""Uniform sharding by a hypergeometric communication matrix.

A uniform random permutation of n rows, cut into shards of fixed sizes, sends to each shard a
multivariate-hypergeometric number of rows of every input partition.  So the matrix of counts
(partition x shard) is drawn first, exactly, with the wanted column sums; each partition is then
permuted locally and cut by its row of the matrix, the pieces are exchanged, and every shard is
permuted again.  Nothing but the matrix is global.

Partitions are logical: a row's partition is a seeded hash of its id and content (and of a number, where rows recur), and the local
permutations order by further seeded hashes.  The result is a function of the rows and the seed,
whatever the files, the splits or a re-run task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

PARTITION_ROWS = 1024
#: Copies of a row that are spelled out at once.
COPIES = 1 << 16
MAX_PARTITIONS = 1 << 16
#: numpy draws a hypergeometric number only from populations below this; larger ones are drawn by inversion.
NUMPY_POPULATION = 10**9
#: Standard deviations around the mean that inversion looks at: what lies beyond has less than 2^-100 of the mass, and a draw 53 bits.
REACH = 13


def _inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number by inversion of its distribution, which is summed from the ratios of neighbours."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    whole = good + bad
    mean = n * (good / whole)
    sd = math.sqrt(mean * (bad / whole) * ((whole - n) / (whole - 1)))
    mode = min(max((n + 1) * (good + 1) // (whole + 2), low), high)
    reach = math.ceil(REACH * sd) + 100
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    # log P(k + 1) / P(k)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_mass = np.concatenate(([0.0], np.cumsum(step)))
    mass = np.cumsum(np.exp(log_mass - log_mass.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    return int(rng.hypergeometric(good, bad, n)) if good + bad < NUMPY_POPULATION else _inverted(rng, good, bad, n)


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts (partition x shard) of a uniform shuffle; row sums ``rows``, column sums ``shards``."""
    if sum(rows) != sum(shards):
        raise ValueError("partition sizes and shard sizes differ in sum")
    rng = np.random.default_rng(seed)
    left = [int(s) for s in shards]
    total = sum(left)
    out = np.zeros((len(rows), len(left)), dtype=np.int64)
    for p, n in enumerate(rows):
        need, rest = int(n), total
        for s, free in enumerate(left):
            rest -= free
            out[p, s] = k = _hypergeometric(rng, free, rest, need) if rest else need
            need -= k
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
        total -= int(n)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, id_col: str, text_col: str, shards: int = 16, seed: int = 20240131) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row of ``df``.

    Law ``rows``: shard sizes differ by one at most; ``slot`` is gapless from 0 in each shard.
    A null text counts as empty (size 1, crc 0), a null id is an id of its own; repeated rows are
    rows of their own, each with its slot; an empty table gives an empty result.  Columns other
    than id and text are not read.

    The matrix has ``MAX_PARTITIONS`` x ``shards`` entries at most, whatever the input; beyond
    that the partitions grow, and each is still sorted by one task with spilling.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    out = _placed(rows, shards, seed)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """``id, size, crc, copy, shard, slot`` of rows (id, size, crc).

    Equal rows are counted before the shuffle and told apart by a number (``copy``, from 0), which takes part in the hashes: so rows that
    recur are dealt over partitions like others.
    """
    spark = rows.sparkSession
    whole = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    # Many copies are spelled out in runs of COPIES, each run where its hash sends it.
    runs = whole.select("id", "size", "crc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("run"))
    few = F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1)
    key = [F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("crc"), F.col("size"), F.col("copy")]
    rows = materialise(runs.select("id", "size", "crc", F.explode(few).alias("copy")), "rows")
    n = rows.count()
    parts = min(max(1, math.ceil(n / PARTITION_ROWS)), MAX_PARTITIONS)
    rows = rows.select("*", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int").alias("part"))

    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most MAX_PARTITIONS rows
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(n, shards), seed)
    bounds = np.cumsum(matrix, axis=1)
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in bounds[i, :-1]]) for i, p in enumerate(order)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType()))]),
    )
    same = ["id", "size", "crc", "copy"]
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), *key), "id", "crc", "size", "copy")
    sent = (
        rows.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "part")  # MAX_PARTITIONS rows of `shards` counts at most
        .select(*same, F.size(F.filter("cuts", lambda c: c <= F.col("at"))).alias("shard"), F.xxhash64(F.lit(seed + 2), *key).alias("h"))
    )
    cells = max(1, math.ceil(parts / shards))
    sent = materialise(sent.withColumn("cell", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * cells).cast("int")), "shards")
    before = (
        sent.groupBy("shard", "cell").count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "cell", F.coalesce("base", F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("h", "id", "crc", "size", "copy")
    placed = sent.withColumn("at", F.row_number().over(within) - 1).join(before, ["shard", "cell"])
    return placed.select(*same, "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))


def sharded_rows(df: DataFrame, id_col: str, text_col: str, shards: int = 16, seed: int = 20240131) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (in place of columns of these names); every row has a slot of its own.

    Null ids and texts, repeated rows and empty tables are as in ``shuffle_into_shards``.  Rows are written with a number each; rows of one id, size and
    crc are told apart by counting along these numbers, within each input partition and then over partitions, so
    no task counts all copies of a hot row.
    """
    df = df.drop("shard", "slot")
    names = [f"_c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, names, strict=True))
    text = F.coalesce(F.col(of[text_col]).cast("string"), F.lit(""))
    keys = {"id": F.coalesce(F.col(of[id_col]).cast("string"), F.lit("null")), "size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text.cast("binary"))}
    rows = materialise(df.toDF(*names).withColumns(keys).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    own = rows.select("id", "size", "crc", "_row")
    again = own.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # The upper bits of a row's number are its partition's.
    copies = own.join(again, ["id", "size", "crc"]).withColumn("_p", F.shiftright("_row", 33))
    upto = Window.partitionBy("id", "size", "crc").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = copies.groupBy("id", "size", "crc", "_p").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("id", "size", "crc", "_p").orderBy("_row")) - 1
    copies = copies.withColumn("nth", nth).join(base, ["id", "size", "crc", "_p"]).select("_row", (F.col("base") + F.col("nth")).alias("copy"))
    own = own.join(copies, "_row", "left").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))
    placed = own.join(_placed(rows.select("id", "size", "crc"), shards, seed), ["id", "size", "crc", "copy"]).select("_row", "shard", "slot")
    return rows.join(placed, "_row").select(*(F.col(x).alias(c) for c, x in of.items()), "shard", "slot")
