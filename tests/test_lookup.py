"""Lookups open few files, and find what a scan finds."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lookup, store
from mnemospark.operators.lookup import LookupIndex, files_read

COLUMNS = "id string, tags array<string>, importance double, is_deleted boolean, bucket int, band string"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    n = F.col("id")
    rows = spark.range(4000).select(
        F.concat(F.lit("r"), n.cast("string")).alias("id"),
        # A third of all records have one tag.
        F.when(n % 3 == 0, F.array(F.lit("hot"), F.concat(F.lit("t"), (n % 50).cast("string")))).otherwise(F.array(F.concat(F.lit("t"), (n % 50).cast("string")))).alias("tags"),
        ((n * 37 % 1000) / 1000.0).alias("importance"), (n % 10 == 9).alias("is_deleted"), (n % 5).cast("int").alias("bucket"), F.lit("x").alias("band"),
    )
    path = str(tmp_path_factory.mktemp("lookup"))
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    return rows, LookupIndex.build(rows, f"{path}/index")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_by_id(records):
    rows, index = records
    assert _rows(index.get("r17")) == _rows(store.get(rows, "r17")) and index.get("r17").columns == rows.columns
    assert index.get("none").count() == 0 and index.get().count() == 0
    assert files_read(index.get("r17")) * 8 <= files_read(index._records())
    ids = rows.filter("id like '%7'").select("id")
    assert _rows(index.fetch(ids)) == _rows(rows.join(ids, "id", "left_semi").select(rows.columns))


def test_many_ids_are_joined(records, monkeypatch):
    rows, index = records
    monkeypatch.setattr(lookup, "NAMED", 10)
    ids = rows.filter("id like '%7'").select("id")
    got = index.fetch(ids.unionByName(ids))
    assert _rows(got.select(rows.columns)) == _rows(rows.join(ids, "id", "left_semi").select(rows.columns))


def test_by_tag(records):
    rows, index = records
    for tag in ("hot", "t7", "none"):
        assert _rows(index.by_tag(tag).select("id")) == _rows(store.by_tag(rows, tag).select("id"))
    every = files_read(index._read("tags", "id string, tag string, lookup_bucket int"))
    assert files_read(index.ids_by_tag("t7")) * 4 <= every


def test_by_importance(records):
    rows, index = records
    for low, high in ((0.25, 0.5), (0.1, 0.1), (0.0, 1.0), (0.999, 2.0), (-1.0, -0.5), (0.6, 0.4)):
        assert _rows(index.by_importance(low, high)) == _rows(store.by_importance(rows, low, high).select("id", "importance"))
    assert files_read(index.by_importance(0.3, 0.31)) * 4 <= files_read(index.by_importance(-1.0, 2.0))


def test_edges(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", None, "x"], None, False, 1, "b"), (None, ["x"], 0.5, False, 2, None), ("a", None, 0.5, False, 1, ""), ("b", [], 0.5, True, 1, ""), ("", [""], 0.5, False, 1, "")], COLUMNS)
    index = LookupIndex.build(rows, str(tmp_path / "some"))
    assert index.get("a").count() == 2 and index.get("").count() == 1
    assert _rows(index.ids_by_tag("x")) == ["Row(id='a')", "Row(id=None)"] and index.ids_by_tag("").count() == 1
    assert index.by_importance(0.5, 0.5).count() == 3
    none = LookupIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert none.get("a").count() == none.by_tag("x").count() == none.by_importance(0.0, 1.0).count() == 0
