"""Secondary layouts of a record table, so that looking up by id, tag or importance opens few files.

Three tables are written once for a table that doesn't change:

* ``records``: whole records, dealt into buckets by a hash of the id, sorted by id within a file, with a Parquet Bloom filter on it.
  A lookup names its buckets, so files of others aren't opened, and of the rest row groups that can't hold the id aren't read.
* ``tags``: a row for each live record and tag, dealt by a hash of the tag and sorted by tag and id.  A tag that a third of all records have
  is many files of one bucket, cut by id.
* ``importance``: live ids in bands of importance between quantiles; a range opens the bands that it meets.

The numbers of buckets and bands follow from the number of records, and are stored with the tables.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import create_text, read_text

#: Records of a bucket or band, at most about this many; below, there are ``LEAST`` of them.
BUCKET_ROWS = 1 << 20
LEAST, MOST = 16, 16_384
#: Ids that are looked up by name; more of them meet the records by a join.
NAMED = 1000
#: Rows of a file: a hot tag is cut into files of this many.
FILE_ROWS = 1 << 20


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("lookup_bucket")


class LookupIndex:
    """The layouts in a folder.  Null and repeated ids keep all their rows; null tags and an importance that is null aren't indexed; an empty table finds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = json.loads(read_text(spark, f"{self.path}/meta.json"))

    @classmethod
    def build(cls, records: DataFrame, path: str) -> LookupIndex:
        """Writes the layouts of records with ``id, tags, importance, is_deleted`` and any other columns but ``lookup_bucket``."""
        spark, path = records.sparkSession, path.rstrip("/")
        n, splits = records.agg(F.count(F.lit(1)), F.percentile_approx("importance", [i / LEAST for i in range(1, LEAST)], 10_000)).first()
        buckets = min(MOST, max(LEAST, -(-n // BUCKET_ROWS)))
        splits = sorted(set(splits or []))
        dealt = records.select("*", _bucket(F.col("id"), buckets))
        # A range of (bucket, id) is a file or two, however large a bucket is.
        dealt.repartitionByRange("lookup_bucket", "id").sortWithinPartitions("lookup_bucket", "id").write.option("parquet.bloom.filter.enabled#id", "true").option("maxRecordsPerFile", FILE_ROWS).partitionBy("lookup_bucket").parquet(f"{path}/records")
        live = spark.read.schema(dealt.schema).parquet(f"{path}/records").filter("not is_deleted")
        tags = live.select("id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null").select("id", "tag", _bucket(F.col("tag"), buckets))
        tags.repartitionByRange("lookup_bucket", "tag", "id").sortWithinPartitions("lookup_bucket", "tag", "id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lookup_bucket").parquet(f"{path}/tags")
        band = F.size(F.filter(F.array(*(F.lit(x) for x in splits)), lambda x: x < F.col("importance"))).cast("int") if splits else F.lit(0)
        ranked = live.filter("importance is not null").select("id", "importance", band.alias("band"))
        ranked.repartitionByRange("band", "importance", "id").sortWithinPartitions("band", "importance", "id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("band").parquet(f"{path}/importance")
        create_text(spark, f"{path}/meta.json", json.dumps({"rows": n, "buckets": buckets, "splits": splits, "schema": dealt.schema.json(), "importance": dict(records.dtypes)["importance"]}))
        return cls(spark, path)

    def _read(self, what: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def _records(self) -> DataFrame:
        from pyspark.sql.types import StructType

        return self._read("records", StructType.fromJson(json.loads(self.meta["schema"])))

    def _numbers(self, keys: list[str]) -> list[int]:
        """Buckets of a few keys."""
        rows = self.spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in keys))).alias("k")).select(_bucket(F.col("k"), self.meta["buckets"])).distinct().collect()
        return sorted(r[0] for r in rows)

    def get(self, *ids: str) -> DataFrame:
        """Records of some ids, deleted or not."""
        if not ids:
            return self._records().drop("lookup_bucket").limit(0)
        return self._records().filter(F.col("lookup_bucket").isin(self._numbers(list(ids))) & F.col("id").isin(list(ids))).drop("lookup_bucket")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Records of a table of ids: a few are named to the scan, more are joined."""
        few = [r[0] for r in ids.select("id").limit(NAMED + 1).collect()]  # NAMED + 1 rows at most
        if len(few) <= NAMED:
            return self.get(*(x for x in few if x is not None))
        keyed = ids.select("id", _bucket(F.col("id"), self.meta["buckets"])).distinct()
        return self._records().join(keyed, ["lookup_bucket", "id"], "left_semi").drop("lookup_bucket")

    def ids_by_tag(self, tag: str) -> DataFrame:
        """Ids of live records with a tag."""
        rows = self._read("tags", "id string, tag string, lookup_bucket int")
        return rows.filter((F.col("lookup_bucket") == self._numbers([tag])[0]) & (F.col("tag") == tag)).select("id")

    def by_tag(self, tag: str) -> DataFrame:
        return self.fetch(self.ids_by_tag(tag))

    def by_importance(self, low: float, high: float) -> DataFrame:
        """``id, importance`` of live records in a range, both ends in it."""
        first, last = bisect_left(self.meta["splits"], low), bisect_left(self.meta["splits"], high)
        rows = self._read("importance", f"id string, importance {self.meta['importance']}, band int")
        return rows.filter(F.col("band").between(first, last) & F.col("importance").between(low, high)).drop("band")


def files_read(df: DataFrame) -> int:
    """Runs a plan of one scan without a shuffle, and says how many files the scan took up."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numFiles").value()) for i in range(leaves.size()))
