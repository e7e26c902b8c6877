"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers and read in segments.  A segment's index holds, for every
attribute, the slices of its leading bits: bitmaps over the segment's rows.  A block of queries is
scored by adding attribute slices, each shifted by the bits of the query's weight, with full adders made of
bitmap operations; the sums are bit-sliced too, one bitmap of each query, bit and segment.

From the most significant slice downward, the k-th largest sum is found by counting bits.  The
attribute bits that the index leaves out move a score by less than a known width, so only rows whose
sum lies within that width of the k-th can be among the first k; these boundary rows are resolved
by exact integer arithmetic.  Results are exact, ties going to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import spread
from .common import arrow_map, materialise

SEGMENT_ROWS = 4096
#: Queries that are broadcast at a time.
QUERY_ROWS = 1 << 14
#: Bits of an attribute in the index.  More bits leave fewer boundary rows, and cost more additions.
INDEX_BITS = 6
SCALE = 1024
#: Numbers under this have sums of 2048 products in 64 bits; larger ones are kept as plain integers.  Quantised numbers end at LIMIT.
NARROW, LIMIT = 1 << 26, 1 << 62
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _order(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """By score, the highest first, then id."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), dtype=np.int64)
    return np.lexsort((ids, -score))


class Segment:
    """The bit-sliced index of some rows (ids ascending, matrix of integers)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bits: int = INDEX_BITS):
        self.ids, self.rows = ids, rows
        self.n, self.dim = rows.shape
        self.low = rows.min(axis=0)
        spread = int((rows - self.low).max())
        self.drop = max(0, spread.bit_length() - bits)
        top = (rows - self.low) >> self.drop
        self.width = max(1, int(top.max()).bit_length())
        self.words = -(-self.n // 64)
        self.slices = np.zeros((self.dim, self.width, self.words), dtype=np.uint64)
        for b in range(self.width):
            packed = np.packbits(((top >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            full = np.zeros((self.dim, self.words * 8), dtype=np.uint8)
            full[:, : packed.shape[1]] = packed
            self.slices[:, b] = full.view(np.uint64)
        self.live = np.zeros(self.words * 64, dtype=np.uint8)
        self.live[: self.n] = 1
        self.live = np.packbits(self.live, bitorder="little").view(np.uint64)

    def sums(self, queries: np.ndarray) -> np.ndarray:
        """Bit-sliced sums (bits x queries x words) of |weight| * (top bits, complemented where the weight is negative)."""
        weight = np.abs(queries)
        full = (1 << self.width) - 1
        most = int((weight.sum(axis=1) * full).max()) if len(queries) else 0
        depth = max(1, most.bit_length())
        acc = np.zeros((depth, len(queries), self.words), dtype=np.uint64)
        for j in range(self.dim):
            flip = np.where(queries[:, j] < 0, _ONES, np.uint64(0))[:, None]
            ready = None
            for b in range(int(weight[:, j].max()).bit_length() if len(queries) else 0):
                who = np.flatnonzero(((weight[:, j] >> b) & 1).astype(bool))
                if not len(who):
                    continue
                if ready is None:
                    ready = self.slices[j][:, None, :] ^ flip[None]
                self._add(acc, ready, b, who)
        return acc

    def _add(self, acc: np.ndarray, slices: np.ndarray, shift: int, who: np.ndarray) -> None:
        carry = None
        for s in range(self.width):
            a, x = acc[shift + s, who], slices[s, who]
            half = a ^ x
            if carry is None:
                acc[shift + s, who] = half
                carry = a & x
            else:
                acc[shift + s, who] = half ^ carry
                carry = (a & x) | (half & carry)
        at = shift + self.width
        while at < len(acc) and carry.any():
            a = acc[at, who]
            acc[at, who] = a ^ carry
            carry = a & carry
            at += 1

    def top(self, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its index, ids and exact scores of rows that hold its first k (by score, then id)."""
        if not len(queries):
            return
        acc = self.sums(queries)
        depth, n = acc.shape[:2]
        # Descend: `above` are rows surely among the first k, `level` those that agree with the k-th so far.
        above = np.zeros((n, self.words), dtype=np.uint64)
        level = np.tile(self.live, (n, 1))
        kth = np.zeros(n, dtype=np.int64 if depth < 62 else object)
        need = min(k, self.n)
        for b in range(depth - 1, -1, -1):
            ones = level & acc[b]
            enough = np.bitwise_count(above | ones).sum(axis=1, dtype=np.int64) >= need
            kth = kth * 2 + enough
            above = np.where(enough[:, None], above, above | ones)
            level = np.where(enough[:, None], ones, level & ~acc[b])
        # A dropped tail adds (2^drop - 1) * |weight| at most, in either direction of the complement.
        slack = np.abs(queries).sum(axis=1) * ((1 << self.drop) - 1)
        floor = np.maximum(kth - -(-slack // (1 << self.drop)), 0)
        chosen = self._at_least(acc, floor)
        for i in range(n):
            rows = np.flatnonzero(np.unpackbits(chosen[i].view(np.uint8), bitorder="little")[: self.n])
            score = self.rows[rows] @ queries[i]
            if len(rows) > k:
                best = _order(self.ids[rows], score)[:k]
                rows, score = rows[best], score[best]
            yield i, self.ids[rows], score

    def _at_least(self, acc: np.ndarray, floor: np.ndarray) -> np.ndarray:
        greater = np.zeros(acc.shape[1:], dtype=np.uint64)
        equal = np.tile(self.live, (acc.shape[1], 1))
        for b in range(len(acc) - 1, -1, -1):
            bit = np.where(((floor >> b) & 1).astype(bool), _ONES, np.uint64(0))[:, None]
            greater |= equal & acc[b] & ~bit
            equal &= ~(acc[b] ^ bit)
        return greater | equal


class Best:
    """The k best rows of each of some queries, as segments come in."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, queries.dtype))] * len(ids)

    def add(self, segment: Segment) -> None:
        if not segment.n:
            return
        # A query's own rows are found too, so as many more are looked for.
        extra = int(np.unique(segment.ids, return_counts=True)[1].max())
        for at in range(0, len(self.ids), 64):
            for i, ids, score in segment.top(self.queries[at : at + 64], self.k + extra):
                i += at
                other = np.flatnonzero(ids != self.ids[i])
                both = np.concatenate((self.found[i][0], ids[other])), np.concatenate((self.found[i][1], score[other]))
                keep = _order(*both)[: self.k]
                self.found[i] = both[0][keep], both[1][keep]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x, _ in self.found]
        score = np.concatenate([np.zeros(0, np.int64), *(np.clip(x, -(1 << 63), (1 << 63) - 1).astype(np.int64) for _, x in self.found)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for x, _ in self.found)])), pa.array(score)], names=["query_id", "vec_id", "score"])


def _matrices(ids: np.ndarray, column: pa.Array, dim: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Ids and rows of one length: those of small numbers, and those whose sums of products could pass 64 bits, as plain integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    wide = (x >= NARROW).any(axis=1) | (x <= -NARROW).any(axis=1)
    for w in (False, True):
        at = np.flatnonzero(wide == w)
        if len(at):
            yield w, ids[at], x[at].astype(object) if w else x[at]


def _search(asked, k: int):
    """Segments of the rows (dim, vec_id, q) as they come, each against all queries of its dimension."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[Best]] = {dim: [Best(ids, q, k) for _, ids, q in parts] for dim, parts in asked.value.items()}
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def segment(key: tuple[int, bool], last: bool) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held[key], strict=True))
            upto = len(ids) if last else len(ids) // SEGMENT_ROWS * SEGMENT_ROWS
            for at in range(0, upto, SEGMENT_ROWS):
                own = np.arange(at, min(at + SEGMENT_ROWS, upto))
                own = own[np.argsort(ids[own], kind="stable")]
                made = Segment(ids[own], rows[own])
                for x in best[key[0]]:
                    x.add(made)
            held[key] = [(ids[upto:], rows[upto:])]

        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                if dim not in best:
                    continue
                own = batch.filter(pa.array(dims == dim))
                for wide, ids, rows in _matrices(own.column(1).to_numpy(zero_copy_only=False), own.column(2), dim):
                    key = (dim, wide)
                    held.setdefault(key, []).append((ids, rows))
                    if sum(len(x) for x, _ in held[key]) >= SEGMENT_ROWS:
                        segment(key, False)
        for key in held:
            segment(key, True)
        for parts in best.values():
            for x in parts:
                yield x.rows()

    return search


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, q`` (array of floor(SCALE * x)) of rows with an id and a whole, finite vector; beyond ``LIMIT`` a number counts as that."""
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.filter(F.col(id_col).isNotNull()).filter(good)
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query the k highest inner products with other rows.

    ``is_query`` is a condition on ``vec_id``.  Vectors that are null, empty or hold a null, NaN or
    infinity take no part, nor do rows of a null id; vectors of another length are no candidates.
    Repeated rows are candidates each; a query id that recurs asks once, with its smallest vector.
    Fewer candidates than k give fewer rows; an empty table none.  Other columns aren't read.
    Scores are exact however large the numbers; a score beyond 64 bits reads as the largest or smallest long.

    Rows stay where they are: every task makes segments of what it reads, and keeps the k best of each query.
    Queries are broadcast, ``query_rows`` at a time; more of them are asked in further passes over the vectors.
    """
    spark = df.sparkSession
    rows = materialise(spread(quantised(df, id_col, vector_col).select(F.size("q").alias("dim"), "vec_id", "q")), "vectors")
    asked = rows.filter(is_query(F.col("vec_id"))).groupBy("dim", "vec_id").agg(F.min("q").alias("q"))
    asked = materialise(asked.groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("x")).select("vec_id", "x.dim", "x.q"), "asked")
    passes = max(1, math.ceil(asked.count() / query_rows))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(passes):
        got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).orderBy("vec_id").toArrow()  # about query_rows rows
        queries = {}
        for dim in sorted(set(got["dim"].to_pylist())):
            own = got.filter(pa.array(got["dim"].to_numpy() == dim)).combine_chunks()
            queries[dim] = list(_matrices(own["vec_id"].to_numpy(), own["q"].chunk(0), dim))
        found = arrow_map(spread(rows), _search(spark.sparkContext.broadcast(queries), k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = found if passes == 1 else materialise(found, "best")
        out = found if out is None else out.unionByName(found)
    return out
