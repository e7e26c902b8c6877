"""MinHash near-duplicate groups, exact on confirmed links.

1.  One pass turns each text into its set of word shingles, a digest of the set, and a signature of
    ``HASHES`` minima under universal (multiply-shift) hashes.
2.  Texts of one set collapse to their smallest id; only these representatives go on.
3.  Signatures are banded; representatives that agree on a band share a bucket.
4.  In every bucket, all members are compared to two hubs (the smallest id, and the smallest seeded
    hash of an id): first by signature, then on the full sets.  Confirmed links give components by
    alternating large-star and small-star.
5.  What is left are pairs of one bucket in different components.  Buckets with several components
    make up regions; members outside a region's largest component are compared to all its members,
    in blocks, through an inverted index of the full sets.  So no link is lost, and no list of pairs is made.

With ``ROWS`` minima a band and ``BANDS`` bands, a pair of similarity s shares a bucket with probability
1 - (1 - s^ROWS)^BANDS: at 0.75, all but 5 in a million.  Signatures rule a pair out below
``SIGNATURE_FLOOR``, five standard deviations under 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, materialise, ship

SHINGLE = 5
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
SIGNATURE_FLOOR = 0.56
PERCENT = 75
#: Texts in a block of what stars leave over, and shingles indexed at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_RNG = np.random.default_rng(20240607)
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(g: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles (with repeats) of a group's documents, and each document's bounds in them."""
    n = np.diff(g.bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(bounds[-1], dtype=np.uint64)
    total = len(g.hashes)
    if total >= SHINGLE:
        rolled = g.hashes[: total - SHINGLE + 1] * _PLACES[0]
        for k in range(1, SHINGLE):
            rolled += g.hashes[k : total - SHINGLE + 1 + k] * _PLACES[k]
    else:
        rolled = np.zeros(0, np.uint64)
    long = np.repeat(n >= SHINGLE, count)
    where = np.repeat(g.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    out[long] = rolled[where[long]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        ws = g.hashes[g.bounds[i] : g.bounds[i + 1]]
        out[bounds[i]] = (ws * _PLACES[: len(ws)]).sum(dtype=np.uint64) + np.uint64(len(ws))
    return textkit.scramble(out), bounds


def sets_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingle hashes of each text."""
    data, offsets = textkit.texts_of(texts)
    for g in textkit.words_of(data, offsets):
        h, bounds = shingle_hashes(g)
        for i in range(g.last - g.first):
            yield g.first + i, np.unique(h[bounds[i] : bounds[i + 1]])


def _minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (documents x HASHES, uint32) of non-empty documents of a group."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.empty((len(full), HASHES), dtype=np.uint32)
    step = 1 << 14
    if not len(full):
        return out
    out.fill(0xFFFFFFFF)
    # Blocks of documents of about `step` shingles stay in the processor's cache; a longer document is folded.
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(bounds[full], bounds[full[i]] + step)))
        a, b = bounds[full[i]], bounds[full[j - 1] + 1]
        if j == i + 1:
            for at in range(a, b, step):
                x = h[at : min(at + step, b)]
                for k in range(HASHES):
                    out[i, k] = min(out[i, k], int(((x * _A[k] + _B[k]) >> np.uint64(32)).min()))
        else:
            x, heads = h[a:b], bounds[full[i:j]] - a
            for k in range(HASHES):
                out[i:j, k] = np.minimum.reduceat((x * _A[k] + _B[k]) >> np.uint64(32), heads)
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textkit.texts_of(batch.column(1))
        size, digest, signature = [], [], []
        for g in textkit.words_of(data, offsets):
            h, bounds = shingle_hashes(g)
            sig = iter(_minima(h, bounds))
            for i in range(g.last - g.first):
                x = np.unique(h[bounds[i] : bounds[i + 1]])
                size.append(len(x))
                if len(x):
                    y = textkit.scramble(x + np.uint64(0xA5A5A5A5A5A5A5A5))
                    digest.append(int(x.sum(dtype=np.uint64)).to_bytes(8, "big") + int(y.sum(dtype=np.uint64)).to_bytes(8, "big"))
                    signature.append(next(sig).tobytes())
                else:
                    digest.append(None)
                    signature.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["id", "n_shingles", "digest", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _matrix(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
        keys = textkit.scramble((sig * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel())], names=["id", "bucket"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough."""
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(same >= SIGNATURE_FLOOR))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets confirm the link.  Sets of a text that recurs in a batch are made once."""
    for batch in batches:
        sides = []
        for c in (2, 3):
            coded = batch.column(c).dictionary_encode()
            made = dict(sets_of(coded.dictionary))
            sides.append([made[k] for k in coded.indices.to_pylist()])
        keep = []
        for x, y in zip(*sides, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) else 0
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _confirm(pairs: DataFrame, signed: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Of distinct pairs (u, v), the links; materialised."""
    sig = signed.select("id", "sig")
    near = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("s")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("t")), "v")
    near = materialise(arrow_map(near.select("u", "v", "s", "t"), _alike, "u long, v long"), f"{name}-near")
    both = near.join(texts.select(F.col("id").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("y")), "v")
    return materialise(arrow_map(both.select("u", "v", "x", "y"), _linked, "u long, v long"), f"{name}-links")


def _rest(split: DataFrame, texts: DataFrame, regions: DataFrame) -> DataFrame:
    """Links between components of a region; materialised.

    Members outside a region's largest component are probes.  Probes and members are dealt into blocks, and
    each pair of blocks is one task's work, which emits a link for each probe and component, not each pair.
    """
    members = split.select("id", "c").distinct().join(regions.select("id", F.col("component").alias("region")), "id")
    parts = members.groupBy("region", "c").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
    whole = whole.select("region", F.col("top.c").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("probing"))
    members = members.join(whole, "region")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = members.filter("c <> largest").withColumn("p", deal("probing")).withColumn("b", every("blocks"))
    members = members.withColumn("b", deal("blocks")).withColumn("p", every("probing"))
    keys = ["region", "p", "b"]
    sides = [x.select(*keys, "id", "c").join(texts, "id").select(*(F.col(k).alias(k) for k in (*keys, "id", "c", "text"))).groupBy(*keys) for x in (probes, members)]
    ship(split.sparkSession)
    return materialise(sides[0].cogroup(sides[1]).applyInPandas(_probe, "u long, v long"), "rest-links")


def _probe(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    found: list[tuple[int, int]] = []
    if len(probes) and len(members):
        asked = [(int(probes["id"].iloc[i]), int(probes["c"].iloc[i]), x) for i, x in sets_of(pa.array(probes["text"], pa.string()))]
        ids, comps = members["id"].to_numpy(np.int64), members["c"].to_numpy(np.int64)
        done: set[tuple[int, int]] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        texts = sets_of(pa.array(members["text"], pa.string()))
        while True:
            nxt = next(texts, None)
            if nxt is not None:
                held.append(nxt)
                size += len(nxt[1])
            if held and (nxt is None or size > BLOCK_SHINGLES):
                at = np.array([i for i, _ in held])
                sizes = np.array([len(x) for _, x in held])
                keys = np.concatenate([x for _, x in held])
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], np.repeat(np.arange(len(held)), sizes)[order]
                for u, c, x in asked:
                    a, b = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
                    n = b - a
                    places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[places], minlength=len(held))
                    for k in np.flatnonzero((100 * both >= PERCENT * (len(x) + sizes - both)) & (both > 0) & (comps[at] != c)).tolist():
                        if (u, int(comps[at[k]])) not in done:
                            done.add((u, int(comps[at[k]])))
                            found.append((u, int(ids[at[k]])))
                held, size = [], 0
            if nxt is None:
                break
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id of the component) of every id in ``links`` (u, v).

    Alternating large-star and small-star: in the large star every node sends its larger neighbours to
    the smallest of its neighbourhood, in the small star its smaller neighbours and itself.  Each step
    is one aggregation with partial minima and one equi-join, so a hub is never gathered in a task.
    Repeated links and loops are allowed; no links give no rows.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has two plain sides, and Spark can split what a hub gathers.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # Every edge (u, v) has v < u: v and u itself go to u's smallest neighbour.
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    flat = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("id"), "component").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer words than a shingle is one
    shingle; a text without words, empty or null has none and is linked with nothing.  Ids are
    integers; rows of a null id are linked with nothing and kept (their component is null); rows of
    one id belong to one component, whatever their texts.  Other columns aren't read; an empty table gives no rows.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(arrow_map(texts, _sign, "id long, n_shingles long, digest binary, sig binary"), "signed")
    filled = signed.filter("id is not null and n_shingles > 0")
    # A row of each set; ids with several texts stand for each of them.
    sets = materialise(filled.groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.struct("id", "sig")).alias("one")), "sets")
    reps = sets.select(F.col("rep").alias("id"), F.col("one.sig").alias("sig"))
    banded = arrow_map(reps, _bands, "id long, bucket long")
    size = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("other"), F.count(F.lit(1)).alias("n"))
    shared = materialise(banded.join(size.filter("n > 1 and hub is not null"), "bucket").select("bucket", "id", "hub", "other"), "buckets")
    pairs = shared.select(F.explode(F.array("hub", "other")).alias("v"), F.col("id").alias("u")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = _confirm(pairs, reps, texts, "stars")
    found = components(links)

    # What stars left in different components of one bucket: regions of such buckets, compared in blocks.
    mine = shared.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")).distinct()
    split = mine.groupBy("bucket").agg(F.min("id").alias("lead"), F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b")
    split = materialise(mine.join(split.select("bucket", "lead"), "bucket").select("id", "lead", "c"), "split")
    links = links.unionByName(_rest(split, texts, components(split.select(F.col("id").alias("u"), F.col("lead").alias("v")))))

    # A row belongs to the component of its set's smallest id; an id with several texts ties their sets together.
    member = filled.join(sets.select("digest", "rep"), "digest").select("id", "rep").distinct()
    first = materialise(member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "members")
    ties = member.join(first.filter("rep <> last").select("id", F.col("rep").alias("to")), "id").select(F.col("rep").alias("u"), F.col("to").alias("v")).filter("u <> v")
    found = components(links.unionByName(ties))
    label = first.select("id", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n_shingles").join(label, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: of its smallest id (of rows of one id, one stays; rows of a null id all stay)."""
    flags = near_duplicates(df, id_col, text_col).filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    flags = materialise(flags.filter("not kept or n > 1"), "flags")
    once = df.join(flags.select(id_col), id_col, "left_anti")
    again = df.join(flags.filter("kept").select(id_col), id_col, "left_semi").dropDuplicates([id_col])
    return once.unionByName(again).select(*df.columns)
