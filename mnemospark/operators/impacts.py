"""A text index in impact order, so that a top k reads the best postings of a gram and leaves out the rest.

A posting's impact is what its text would score for the gram if its inverse document frequency were 1.  Impacts are cut into ``STEPS`` levels
a unit; a block is the postings of a gram and field on one level.  Five tables: those of ``postings``, in which ``postings`` has each row's
``level`` too and is sorted by gram, then from the highest level down; ``blocks`` (gram, field, level, n, top), with each block's
number of postings and greatest impact; and ``texts`` (id, field, text, len), sorted by id, where hits are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from .postings import NAMED, SALT, TextIndex, any_of, few_names, named, spelled

STEPS = 1024


def level_of(impact: Column) -> Column:
    return F.floor(impact * STEPS).cast("int")


class ImpactIndex(TextIndex):
    """Beside what ``TextIndex`` has.  Ids must be unique; rows without one are found by nothing, null fields are no texts."""

    last = "grams"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.blocks, self.texts = (spark.read.parquet(f"{path}/{x}") for x in ("blocks", "texts"))

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, Column], path: str, grams: list[str] | None = None) -> ImpactIndex:
        spark = docs.sparkSession
        written = lambda x: spark.read.parquet(f"{path}/{x}")
        rows, found = spelled(docs.filter("id is not null"), fields, grams)
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/texts")
        written("texts").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/sizes")
        ranked = found.filter("gram is not null").join(F.broadcast(written("sizes").select("field", "avg_len")), "field")  # a row a field
        ranked = ranked.select("gram", "field", "id", "tf", "len", level_of(X.bm25_part(F.lit(1.0), F.col("tf"), F.col("len"), F.col("avg_len"))).alias("level"))
        dealt = ranked.repartition("gram", F.pmod(F.xxhash64("id"), F.lit(SALT)))
        dealt.sortWithinPartitions("gram", F.desc("level")).write.mode("overwrite").parquet(f"{path}/postings")
        impact = X.bm25_part(F.lit(1.0), F.col("tf"), F.col("len"), F.col("avg_len"))
        blocks = written("postings").join(F.broadcast(written("sizes").select("field", "avg_len")), "field").groupBy("gram", "field", "level").agg(F.count(F.lit(1)).alias("n"), F.max(impact).alias("top"))
        # Frequencies are sums over blocks, so postings are counted once.
        blocks.repartition("gram").sortWithinPartitions("gram", F.desc("level")).write.mode("overwrite").parquet(f"{path}/blocks")
        written("blocks").groupBy("gram", "field").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/grams")
        return cls(spark, path)

    def blocks_of(self, grams: DataFrame) -> DataFrame:
        """Blocks, at least those of some grams."""
        return named(self.blocks, few_names(grams))

    def from_level(self, cuts: DataFrame) -> DataFrame:
        """Postings, at least those of each ``gram`` from its ``low``est level up: of a few grams, the scan reads no other pages."""
        least = cuts.groupBy("gram").agg(F.min("low").alias("low")).limit(NAMED + 1).collect()
        if not 0 < len(least) <= NAMED:
            return self.postings
        return self.postings.filter(any_of([(F.col("gram") == r["gram"]) & (F.col("level") >= r["low"]) for r in sorted(least)]))

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """Texts, at least those of some ids: of a few, the scan reads no other pages."""
        few = [r["id"] for r in ids.select("id").distinct().limit(NAMED + 1).collect()]
        return self.texts.filter(any_of([F.col("id") == i for i in sorted(few)])) if 0 < len(few) <= NAMED else self.texts
