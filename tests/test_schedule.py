"""What falls due is what a plain walk over time finds, however records are divided into batches."""

import datetime
import random

from pyspark.sql import functions as F

from mnemospark.streaming import schedule

HOUR = 3_600_000_000


def _plain(records, late_us, gate):
    """Hour by hour, for each project."""
    end = max(us for _, us in records) - late_us
    out = []
    for project in {p for p, _ in records}:
        times = sorted(us for p, us in records if p == project)
        last = 0
        for hour in range(times[0] // HOUR + 1, end // HOUR + 2):
            at = hour * HOUR
            if at >= end:
                break
            if hour % 12 == 0:
                out.append((project, "cleanup", at, 0))
            if hour % 24 == 0:
                out.append((project, "recalculate", at, 0))
            if hour % 168 == 0 and (n := sum(last <= t < at for t in times)) >= gate:
                out.append((project, "consolidate", at, n))
                last = at
    return sorted(out, key=repr)


def _records(spark, rows):
    return spark.createDataFrame(rows, "project string, us long").select("project", F.timestamp_micros("us").alias("ts"))


def test_replay(spark):
    r = random.Random(3)
    start = int(datetime.datetime(2024, 1, 3, 5, tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    rows = [(r.choice(["p", "p", "q", None]), start + r.randrange(60 * 24) * HOUR + r.choice([0, 1, 999_999])) for _ in range(160)]
    want = _plain(rows, 24 * HOUR, 20)
    assert {w[1] for w in want} == {"cleanup", "recalculate", "consolidate"}
    for files in (1, 3):
        got = [tuple(x) for x in schedule.replayed(_records(spark, rows + [("q", None)]), "1 day", files).collect()]
        assert sorted(got, key=repr) == want


def test_division_into_batches():
    r = random.Random(4)
    records = [("p", r.randrange(0, 90 * 24) * HOUR) for _ in range(300)]
    want = [w[1:] for w in _plain(records, 0, 20)]
    end = max(us for _, us in records)
    for cuts in (1, 2, 7, 40):
        s, got = {"next": {}, "weeks": {}, "pending": 0}, []
        edges = sorted(r.randrange(end) for _ in range(cuts - 1)) + [end]
        low = -1
        for edge in edges:
            cells = {}
            for _, us in records:
                if low < us <= edge:
                    cells[us // schedule.CELL_US] = cells.get(us // schedule.CELL_US, 0) + 1
            got += schedule.advance(s, cells, 0 if low < 0 else low)
            low = edge
        got += schedule.advance(s, {}, end)
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_actions(spark, tmp_path):
    rows = [("p", d * 24 * HOUR) for d in range(1, 40)]
    _records(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = schedule.falling_due(spark.readStream.schema("project string, ts timestamp").parquet(str(tmp_path / "in")), "0 seconds")
    seen = {"consolidate": 0, "cleanup": 0}

    def count(task):
        def run(due, number):
            seen[task] += due.count()

        return run

    schedule.act(stream, {t: count(t) for t in seen}, str(tmp_path / "checkpoint")).awaitTermination()
    want = _plain(rows, 0, 20)
    assert seen == {t: sum(w[1] == t for w in want) for t in seen}
