"""Splitting long texts at sentence ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

MAX_BYTES, MIN_BYTES = 7500, 1000
#: Fixed values.  Ends of sentences in the order in which they are tried: by kind, not by place.
SENTENCE_ENDS = tuple(s.encode() for s in ("？", "！", "。", "\n", "?", "!", "."))


def split(text: str, size: int = MAX_BYTES) -> list[str]:
    """Parts of at most ``size`` bytes.

    A part ends after the last sentence end of the first kind that stands over ``MIN_BYTES`` into it, else
    at the last whole character; concatenated, parts are the text.  Where a part can't hold one character it holds that character.
    """
    raw, out, start = text.encode("utf-8", "surrogatepass"), [], 0
    while start < len(raw):
        end = min(start + size, len(raw))
        if end < len(raw):
            while end > start and raw[end] & 0xC0 == 0x80:
                end -= 1
            for mark in SENTENCE_ENDS:
                at = raw.rfind(mark, start, end)
                if at >= 0 and at + len(mark) > start + MIN_BYTES:
                    end = at + len(mark)
                    break
            if end == start:
                end += 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
        out.append(raw[start:end].decode("utf-8", "surrogatepass"))
        start = end
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split(t) if t is not None else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["id", "parts"])


def chunk(memories: DataFrame) -> DataFrame:
    """``id, part, total, content``; texts of up to ``MAX_BYTES`` are one part."""
    ship(memories.sparkSession)
    rows = memories.select("id", "content")
    parts = rows.mapInArrow(_split, "id string, parts array<string>")
    return parts.select("id", F.posexplode("parts").alias("at", "content"), F.size("parts").alias("total")).select("id", (F.col("at") + 1).alias("part"), "total", "content")
