"""A Merkle manifest of a dataset: a digest of every row, a tree for each group, a root over all, and proofs.

Leaves of a group are numbered in order: rows are sorted over ranges, and what precedes a range is a sum of counts, so no group
is ordered in one task.  Levels are windows: partitioned by group and parent's number, the full frame's ``collect_list`` in
order is both the parent's preimage and the siblings of each child; parents are deduplicated before the next level.  A
path is handed down from the root, a level at a time, and meets the rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT = 8
#: Ranges times groups whose counts are broadcast; more of them meet the rows by a join.
OFFSETS = 100_000
STEP = "array<struct<place:int,run:array<string>>>"


def encoded(column: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in fields)), 256)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 in their group ``g``, and ``size``, the group's rows; written.

    Equal rows are dealt over ranges by a salt, as their order doesn't matter.
    """
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    ranged = rows.repartitionByRange("g", *order, "_salt").sortWithinPartitions("g", *order).drop("_salt")
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    parts = ranged.groupBy(F.shiftright("_at", 33).alias("_part"), "g").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.select("_part", "g", (before - F.col("_first")).alias("_shift"), F.sum("n").over(w).alias("size")), f"{name}-offsets")
    parts = F.broadcast(parts) if parts.count() <= OFFSETS else parts
    out = ranged.withColumn("_part", F.shiftright("_at", 33)).join(parts, ["_part", "g"])
    return out.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_part")


def _levels(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels above ``leaves`` (g, idx, size, digest), lowest first: ``g, idx, size, digest, run``; a group ends with the level at which it has one node."""
    out: list[DataFrame] = []
    nodes = leaves.select("g", "idx", "size", "digest").filter("size > 1")
    w = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        runs = nodes.withColumn("parent", F.floor(F.col("idx") / fanout)).withColumn("run", F.collect_list("digest").over(w))
        parents = runs.dropDuplicates(["g", "parent"]).select("g", F.col("parent").alias("idx"), F.ceil(F.col("size") / fanout).cast("long").alias("size"), F.sha2(F.array_join("run", ""), 256).alias("digest"), "run")
        parents = materialise(parents, f"{name}-{len(out) + 1}")
        largest = parents.agg(F.max("size")).first()[0]
        if largest is not None:
            out.append(parents)
        if largest is None or largest == 1:
            return out
        nodes = parents.drop("run").filter("size > 1")


def _subroots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``g, digest`` of the one node that each group ends with."""
    out = leaves.filter("size = 1").select("g", "digest")
    for level in levels:
        out = out.unionByName(level.filter("size = 1").select("g", "digest"))
    return out


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """``leaves`` with the columns of their group's ``tops`` (g, path, ...), the path led on to the leaf; a step has a place and the run around it."""
    more = [c for c in tops.columns if c not in ("g", "path")]

    def below(nodes: DataFrame, above: DataFrame | None, keep: list[str]) -> DataFrame:
        out = nodes.filter("size = 1").join(tops, "g").select("g", "idx", *keep, *more, "path")
        if above is None:
            return out
        up = above.select("g", F.col("idx").alias("parent"), F.col("run").alias("_run"), F.col("path").alias("_path"), *more)
        step = F.array(F.struct(F.pmod("idx", F.lit(fanout)).cast("int").alias("place"), F.col("_run").alias("run")))
        led = nodes.filter("size > 1").withColumn("parent", F.floor(F.col("idx") / fanout)).join(up, ["g", "parent"])
        return out.unionByName(led.select("g", "idx", *keep, *more, F.concat(step, "_path").cast(STEP).alias("path")))

    above = None
    for k in range(len(levels) - 1, -1, -1):
        above = materialise(below(levels[k], above, ["run"]), f"{name}-{k + 1}")
    return below(leaves, above, [c for c in leaves.columns if c not in ("g", "idx")])


def proof_text(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.array_join(F.filter(s["run"], lambda _, i: i != s["place"]), "")), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    left = lambda s: F.array_join(F.slice(s["run"], F.lit(1), s["place"]), "")
    right = lambda s: F.array_join(F.slice(s["run"], s["place"] + 2, F.size(s["run"])), "")
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(left(s), d, right(s)), 256))


def manifest(df: DataFrame, fields: list[str], group_col: str, order_col: str, tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """``order_col, leaf, subroot, root, proof, folded_root, verified`` of every row.

    A leaf is the sha256 of the ``fields`` as ``encoded`` writes them.  In each group of ``group_col`` leaves ascend by ``order_col``, and every ``fanout``
    consecutive nodes become one while there are several; what groups end with goes on likewise, in order of the group (null first, by
    UTF-8 bytes).  ``proof`` joins the siblings' digests from the row to the root; ``folded_root`` is made of them and of the row's
    leaf with ``tampered`` columns in place of its own, and ``verified`` says whether it is the root.

    Null fields, groups and orders are values like others, nulls first.  Rows of one order go by their leaves, and equal rows are leaves
    each for itself.  Other columns aren't read; an empty table has no rows and no root.
    """
    own = leaf([F.col(c) for c in fields])
    changed = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), F.col(order_col).alias("order"), own.alias("digest"), changed.alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    # Written first, so that numbers of rows are those of files, whoever reads them again.
    leaves = _numbered(materialise(rows, "leaves"), ["order", "digest"], "numbered")
    levels = _levels(leaves, fanout, "level")
    groups = _subroots(leaves, levels).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
    groups = _numbered(materialise(groups, "subroots"), ["group"], "groups")
    upper = _levels(groups, fanout, "upper")
    root = _subroots(groups, upper).select("g", F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    tops = _with_paths(groups, upper, root, fanout, "upper-paths").select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    out = _with_paths(leaves, levels, materialise(tops, "tops"), fanout, "paths")
    back = folded(F.coalesce("other", "digest"), F.col("path"))
    out = out.select(F.col("order").alias(order_col), F.col("digest").alias("leaf"), "subroot", "root", proof_text(F.col("path")).alias("proof"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
