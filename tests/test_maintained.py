"""Statistics after changes are those of a scan."""

import datetime
import random

from mnemospark.operators import store
from mnemospark.operators.maintained import FAN, MaintainedStats

SCHEMA = "memory_type string, project_id string, importance double, is_deleted boolean, content string, last_accessed timestamp_ntz"
DAY = datetime.datetime(2024, 1, 1)


def _row(r):
    return (r.choice(["a", "b", None]), r.choice(["p", "q", None]), r.choice([None, 0.0, 1.0, round(r.random(), 3)]), r.random() < 0.3, r.choice(["", None, "é" * r.randrange(9)]), r.choice([None, DAY + datetime.timedelta(hours=r.randrange(40))]))


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def _same(spark, stats, held):
    now = spark.createDataFrame(held, SCHEMA)
    got, want = stats.stats().collect(), store.stats(now, "corrected").collect()
    assert got == want
    assert _rows(stats.rollup()) == _rows(store.rollup(now))
    assert _rows(stats.project_counts().select("project_id", "memory_count", "last_activity")) == _rows(store.project_counts(now))
    assert _rows(stats.importance_histogram().select("bucket", "memory_type", "n")) == _rows(store.importance_histogram(now))


def test_random_changes(spark, tmp_path):
    r = random.Random(5)
    stats, held = MaintainedStats(spark, str(tmp_path)), []
    for _ in range(9):
        added = [_row(r) for _ in range(r.randrange(12))]
        r.shuffle(held)
        cut = r.randrange(len(held) // 2 + 1)
        removed, held = held[:cut], held[cut:] + added
        stats.change(spark.createDataFrame(added, SCHEMA), spark.createDataFrame(removed, SCHEMA))
    assert len(stats.parts) < 2 * FAN
    _same(spark, stats, held)
    stats.vacuum()
    _same(spark, MaintainedStats(spark, str(tmp_path)), held)


def test_all_gone(spark, tmp_path):
    r = random.Random(6)
    rows = spark.createDataFrame([_row(r) for _ in range(20)] * 2, SCHEMA)
    stats = MaintainedStats(spark, str(tmp_path))
    stats.change()
    assert stats.stats().first()["total"] == 0
    stats.change(rows)
    stats.change(removed=rows)
    assert stats.stats().first()["total"] == 0 and stats.project_counts().count() == 0 and stats.importance_histogram().count() == 0
