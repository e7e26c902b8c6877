"""SimHash near duplicates: 64-bit fingerprints, linked where few bits differ, found by deletion variants.

1.  A fingerprint is the majority of the bits of a text's shingle hashes, counted over the whole text.
2.  Equal fingerprints are one.  Two that differ in three bits at most differ in one at most in one of their two halves, so
    a fingerprint is indexed by each half with each of its bits struck out, and equal keys are met.
3.  In the bucket of bit 0 all pairs are verified; in any other only pairs that differ in the struck bit, as the
    others meet elsewhere.  A bucket is read in order of a sorted partition, so it need not fit a task: beyond ``LIMIT`` fingerprints it is
    cut again by variants of the bits that are still free, which leaves 1024 different fingerprints at most after two cuts.
    A bucket gives a spanning forest of its links, not all pairs.
4.  Components of fingerprints by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .minhash import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints of a bucket that are compared at once, and buckets whose pairs are compared one by one.
LIMIT, SMALL = 4096, 8
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14

_LOW = (1 << 32) - 1


def fingerprint(text: str) -> int:
    """The majority of the bits of the hashes of all shingles of a text, repeats included; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII separators alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), COUNTED):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + COUNTED], stops[at : at + COUNTED], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(x.as_py() or "") for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "fp"])


def _pairs_of_runs(fp: np.ndarray, bit: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of runs of ``SMALL`` at most: all lags of all runs at once."""
    run = np.repeat(np.arange(len(size)), size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    x, b = fp[at], bit[at]
    for lag in range(1, int(size.max(initial=0))):
        u, v = x[:-lag], x[lag:]
        differ = u ^ v
        ok = (run[:-lag] == run[lag:]) & (differ != 0) & (np.bitwise_count(differ) <= BITS) & ((b[lag:] == 0) | (differ & b[lag:] != 0))
        yield u[ok], v[ok]


def _forest(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one bucket that join all that its pairs join: each fingerprint is met with those not yet reached."""
    rest = np.unique(x)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            near = np.bitwise_count(rest ^ q) <= BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                queue += list(found)
                yield np.full(len(found), q), found


def _met(limit: int | None):
    """Of rows (key, part, bit, fp) sorted by key and part: links (u, v), and the rows of buckets over ``limit`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        over: tuple[int, int] | None = None  # the bucket that goes on and is too large

        def out(u, v, large) -> pa.RecordBatch:
            key, part, bit, fp = large
            n, m = len(u), len(key)
            col = lambda x, y: pa.array(np.concatenate((x.view(np.int64), y)))
            none = pa.nulls(n, pa.int64())
            keyed = lambda x: pa.concat_arrays([none, pa.array(x)])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(u.view(np.int64)), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(v.view(np.int64)), pa.nulls(m, pa.int64())]), keyed(key), keyed(part), keyed(bit), keyed(fp)], names=["u", "v", "key", "part", "bit", "fp"])

        def buckets(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, over
            key, part, bit, fp = rows
            n = len(key)
            if not n:
                return
            head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            size = np.diff(np.append(head, n))
            large = np.zeros(n, bool)
            ready = np.ones(len(head), bool)
            if over is not None and (int(key[0]), int(part[0])) == over:
                large[: size[0]] = True
                ready[0] = False
                if len(head) > 1:
                    over = None
            else:
                over = None
            if limit is not None:
                for i in np.flatnonzero(ready & (size > limit)):
                    large[head[i] : head[i] + size[i]] = True
                    ready[i] = False
                    if i == len(head) - 1:
                        over = (int(key[-1]), int(part[-1]))
            keep = n
            if not last and ready[-1]:
                ready[-1] = False
                keep = int(head[-1])
            held = [x[keep:] for x in rows]
            f, b = fp.view(np.uint64), bit.view(np.uint64)
            pairs = list(_pairs_of_runs(f, b, head[ready & (size <= SMALL) & (size > 1)], size[ready & (size <= SMALL) & (size > 1)]))
            for i in np.flatnonzero(ready & (size > SMALL)):
                pairs += _forest(f[head[i] : head[i] + size[i]])
            u, v = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
            if len(u) or large.any():
                yield out(u, v, [x[large] for x in rows])

        for batch in batches:
            yield from buckets([np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)], False)
        yield from buckets(held, True)

    return run


def _halves(free: int) -> tuple[list[int], list[int]]:
    bits = [i for i in range(64) if free >> i & 1]
    return bits[: (len(bits) + 1) // 2], bits[(len(bits) + 1) // 2 :]


def _free(part: int, cuts: int) -> int:
    """Bits in which fingerprints of a bucket may still differ; ``part`` has the struck bits of its cuts, the last one lowest."""
    free = (1 << 64) - 1
    for k in range(cuts - 1, -1, -1):
        struck = part >> 6 * k & 63
        half = next(h for h in _halves(free) if struck in h)
        free = free & ~sum(1 << i for i in half) | 1 << struck
    return free


def _recut(cuts: int):
    """Rows of too large buckets of so many cuts, by each variant of the bits that are still free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for p in np.unique(part).tolist():
                x, free = fp[part == p].view(np.uint64), _free(p, cuts)
                for half in _halves(free):
                    for i in half:
                        agreed = ((1 << 64) - 1) & ~free | sum(1 << j for j in half if j != i)
                        bit = np.full(len(x), 0 if i == half[0] else 1 << i, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array((x & np.uint64(agreed)).view(np.int64)), pa.array(np.full(len(x), p << 6 | i, np.int64)), pa.array(bit.view(np.int64)), pa.array(x.view(np.int64))], names=["key", "part", "bit", "fp"])

    return run


INDEX = "key long, part long, bit long, fp long"


def links(fingerprints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``u, v``: links that join all distinct ``fp`` within ``BITS`` bits of each other, and no others."""
    variants = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"))
    struck, half = F.expr("shiftleft(1L, part)"), F.when(F.col("part") < 32, F.lit(_LOW)).otherwise(F.lit(~_LOW))
    first = F.col("part") % 32 == 0
    index = variants.select(F.col("fp").bitwiseAND(half).bitwiseAND(F.bitwise_not(struck)).alias("key"), F.col("part").cast("long").alias("part"), F.when(first, F.lit(0).cast("long")).otherwise(struck).alias("bit"), "fp")
    found = None
    for cuts in (1, 2, 3):
        rows = index.repartition("key", "part").sortWithinPartitions("key", "part")
        met = materialise(arrow_map(rows, _met(limit if cuts < 3 else None), f"u long, v long, {INDEX}"), f"simhash-links-{cuts}")
        own = met.filter("u is not null").select("u", "v")
        found = own if found is None else found.unionByName(own)
        large = met.filter("key is not null").select("part", "fp")
        if cuts == 3 or large.isEmpty():
            return found
        index = arrow_map(large, _recut(cuts), INDEX)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id, fingerprint, component_id`` of every row; the fingerprint in 16 hexadecimal digits.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer than three words is one shingle; a text without words,
    empty or null has the fingerprint zero and is linked like any other.  Rows of one id aren't tied by it: each has the component of its own
    text.  A row of a null id has a component, and its id counts for none.  Other columns aren't read; an empty table gives no rows.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(arrow_map(texts, _sign, "id long, fp long"), "simhash")
    alike = materialise(signed.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    found = materialise(components(links(alike.select("fp"), limit)).withColumnRenamed("id", "fp"), "simhash-components")
    least = found.join(alike, "fp").groupBy("component").agg(F.min("least").alias("first"))
    linked = found.join(least, "component").select("fp", "first")
    label = materialise(alike.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id")), "simhash-labels")
    out = signed.join(label, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
