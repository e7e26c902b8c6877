"""The stateful fold: the batch fold whatever the order of arrival, and timers that end hidden records."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemospark.operators import store
from mnemospark.streaming import folding

LOG = "seq long, ts timestamp, op string, id string, value string"
START = datetime(2024, 1, 1)


def random_log(seed, ids=60, n=900):
    rng = random.Random(seed)
    kinds = ["add", "update", "replace", "tag", "tag", "delete", "delete", "recover"]
    rows = []
    for seq in range(n):
        op = rng.choice(kinds)
        value = None if op in ("delete", "recover") else rng.choice("xyz") if op == "tag" else f"v{seq}"
        rows.append((seq, START + timedelta(minutes=seq), op, f"id{rng.randrange(ids)}", value))
    return rows


def test_order_of_arrival_does_not_matter(spark):
    """Any order, and replays, give what the batch fold gives of the whole log."""
    rows = random_log(1)
    want = {r["id"]: (r["value"], r["tags"], r["is_deleted"], r["deleted_at"]) for r in store.fold(spark.createDataFrame(rows, LOG)).collect()}
    assert 10 < len(want) < 60
    for seed in range(6):
        order = rows + random.Random(seed).sample(rows, 200)
        random.Random(seed).shuffle(order)
        states = {}
        for seq, ts, op, key, value in order:
            s = states.setdefault(key, json.loads(json.dumps(folding.NEW)))
            folding.apply(s, seq, int((ts - START).total_seconds() * 1e6), op, value)
            states[key] = json.loads(json.dumps(s))
        got = {}
        for key, s in states.items():
            state, at = folding.outcome(s)
            if state != "gone":
                tags = folding.emitted(key, s)["tags"][0]
                got[key] = (s["value"], tags, state == "soft", None if at is None else START + timedelta(microseconds=at))
        assert got == want


def test_stream_is_the_batch_fold(spark):
    rows = random_log(2, ids=20, n=150)
    random.Random(3).shuffle(rows)
    log = spark.createDataFrame([*rows, (None, START, "add", "lost", "x"), (999, START, "add", None, "x")], LOG)
    key = lambda df: sorted(tuple(map(str, (r["id"], r["value"], r["tags"], r["is_deleted"], r["deleted_at"]))) for r in df.collect())
    whole = spark.createDataFrame(rows, LOG)
    assert key(folding.folded(log, files=3)) == key(store.fold(whole))


def test_timers_end_hidden_records(spark, tmp_path):
    """A record hidden for 31 days goes when the watermark passes that, one hidden for 10 stays, and an add begins anew."""
    day = lambda n: START + timedelta(days=n)
    batches = [
        [(1, day(0), "add", "old", "a"), (2, day(0), "add", "new", "b"), (3, day(1), "delete", "old", None), (4, day(0), "add", "back", "c"), (5, day(1), "delete", "back", None), (6, day(2), "recover", "back", None)],
        [(7, day(30), "delete", "new", None)],
        [(8, day(41), "update", "back", "d")],
        [(9, day(42), "tag", "back", "t")],
    ]

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        folding.keep(folding.folding(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {r["id"]: (r["state"], r["value"]) for r in folding.current(spark, str(tmp_path / "out"), gone=True).collect()}

    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {"old": ("gone", "a"), "new": ("soft", "b"), "back": ("live", "d")}
    # The stream goes on from its checkpoint.
    spark.createDataFrame([(10, day(43), "add", "old", "again")], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {"old": ("live", "again"), "new": ("soft", "b"), "back": ("live", "d")}
    assert {r["id"] for r in folding.current(spark, str(tmp_path / "out")).collect()} == {"old", "new", "back"}
    assert folding.current(spark, str(tmp_path / "out")).filter(F.col("id") == "back").first()["tags"] == ["t"]


def test_records_share_calls(spark, monkeypatch):
    """Records of a bucket are folded by one call and keep what is theirs: any number of buckets gives the batch fold."""
    rows = random_log(5, ids=40, n=300)
    log = spark.createDataFrame(rows, LOG)
    key = lambda df: sorted(tuple(map(str, (r["id"], r["value"], r["tags"], r["is_deleted"], r["deleted_at"]))) for r in df.collect())
    assert folding.folded(log, files=2, buckets=3).count() > 3
    assert key(folding.folded(log, files=2, buckets=3)) == key(store.fold(log))
