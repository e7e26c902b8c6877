"""Embedding of texts: a protocol, and an embedder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, ship


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """Texts x dimension."""


class HashingEmbedder:
    """Signed hashes of words, of unit length; the same text always gives the same vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                out[i, (h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "content") -> DataFrame:
    """``rows`` with ``embedding``; Arrow batches are the embedder's batches."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed(texts.fillna("").tolist())))

    return rows.withColumn("embedding", run(F.col(text_col)))


def embedded_once(rows: DataFrame, embedder: Embedder, text_col: str = "content", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``embedding``, and the texts that were embedded anew (``sha256, embedding``).

    Each distinct text is embedded once, and not at all if the ``cache`` (sha256, embedding) has it.  Texts are known by their digests; a null text is an empty one.
    """
    keyed = rows.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_sha", F.sha2("_text", 256))
    texts = keyed.select(F.col("_sha").alias("sha256"), "_text").dropDuplicates(["sha256"])
    if cache is not None:
        texts = texts.join(cache.select("sha256"), "sha256", "left_anti")
    fresh = materialise(embedded(texts, embedder, "_text").select("sha256", "embedding"), "embedded")
    known = fresh if cache is None else fresh.unionByName(cache.select("sha256", "embedding"))
    return keyed.join(known, keyed["_sha"] == known["sha256"]).drop("_text", "_sha", "sha256"), fresh
