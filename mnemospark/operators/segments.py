"""A text index that changes in place: segments of postings, tombstones, and merges by size.

A change writes one segment: the postings of what is added, the tombstones of what is removed, and how document frequencies move.
Nothing that was written before is read or touched.  A search reads all segments: frequencies are sums over them, and a
posting counts unless a later segment has a tombstone of its record.  Segments of one size class are merged when there are
``FAN`` of them, so a posting is written again some log(n) times and there are few segments to read; a merge drops dead postings.

What the index consists of is in numbered manifests, each of which names its segments.  A change becomes visible with its manifest, which is
created only if no other writer made one of this number: the loser of two concurrent changes raises ``Conflict``.  A manifest and the
segments that it names stay as they are, so that searches in progress go on, until ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import create_text, delete, listed, materialise, read_text
from .postings import by_gram, few_names, named, spelled

#: Segments of one size class that become one, and the ratio of classes.
FAN = 4
#: Merge all once the tombstones are this part of the records.
DEAD_SHARE = 0.25
#: Tombstones that are broadcast in a search; more of them meet the postings by a join.
BROADCAST_DEAD = 100_000

POSTINGS = "gram string, field string, id string, tf int, len long, seq long"
GRAMS = "gram string, field string, df long"
DEAD = "id string, seq long"


class SegmentIndex:
    """An index in a folder; ``fields`` are the texts of a record, by name.  Sizes of segments are numbers of texts.

    Null fields are no texts; an empty index and one without segments find nothing.  With ``grams`` it holds these alone: it follows the changes for the
    requests that these are of, which must be the same whenever it is opened.
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Column], grams: list[str] | None = None):
        self.spark, self.path, self.fields, self.grams_ = spark, path.rstrip("/"), fields, grams
        self.refresh()

    # --- state ---

    def refresh(self) -> None:
        """Reads the last manifest."""
        self.version, self.state = 0, {"seq": 0, "segments": [], "mark": None}
        names = [x for x in listed(self.spark, f"{self.path}/manifest") if x.endswith(".json")]
        if names:
            self.state = json.loads(read_text(self.spark, f"{self.path}/manifest/{max(names)}"))
            self.version = int(max(names).removesuffix(".json"))

    def _commit(self, segments: list[dict], seq: int, mark: object) -> None:
        state = {"seq": seq, "segments": segments, "mark": mark}
        create_text(self.spark, f"{self.path}/manifest/{self.version + 1:08d}.json", json.dumps(state))
        self.refresh()

    def _read(self, what: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        names = [s["name"] for s in (self.state["segments"] if segments is None else segments) if s[what]]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}/{what}" for n in names)) if names else self.spark.createDataFrame([], schema)

    # --- changes ---

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, mark: object = None) -> None:
        """Takes records out and in, at once; ``mark`` is kept with the state.

        ``removed`` has the fields as they were when the record was added: they say which frequencies go down.  A record that changes is in
        both.  Rows of one id in ``added`` must be one, and an id that the index holds must be in ``removed``.
        """
        seq = self.state["seq"] + 1
        name = f"segments/{seq:012d}-{uuid.uuid4().hex}"
        sizes: dict[str, list[int]] = {}
        moves, has = None, {"postings": 0, "grams": 0, "dead": 0}
        for rows, sign in ((added, 1), (removed, -1)):
            if rows is None:
                continue
            texts, found = spelled(rows, self.fields, self.grams_)
            n = 0
            for r in texts.groupBy("field").agg(F.count(F.lit(1)), F.sum("len")).collect():  # a row a field
                n += r[1]
                own = sizes.setdefault(r[0], [0, 0])
                own[0], own[1] = own[0] + sign * r[1], own[1] + sign * r[2]
            if not n:
                continue
            if sign > 0:
                has["postings"] = n
                by_gram(found.filter("gram is not null").withColumn("seq", F.lit(seq).cast("long"))).write.parquet(f"{self.path}/{name}/postings")
                found = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings")
            else:
                has["dead"] = n
                rows.select("id", F.lit(seq).cast("long").alias("seq")).write.parquet(f"{self.path}/{name}/dead")
            part = found.filter("gram is not null").groupBy("gram", "field").agg((F.count(F.lit(1)) * sign).alias("df"))
            moves = part if moves is None else moves.unionByName(part).groupBy("gram", "field").agg(F.sum("df").alias("df"))
        if has["postings"] or has["dead"]:
            has["grams"] = 1
            moves.filter("df <> 0").sortWithinPartitions("gram").write.parquet(f"{self.path}/{name}/grams")
            segment = {"name": name, "low": seq, "high": seq, "sizes": sizes, **has}
            self._commit([*self.state["segments"], segment], seq, mark if mark is not None else self.state["mark"])
            self.merge()
        elif mark is not None and mark != self.state["mark"]:
            self._commit(self.state["segments"], self.state["seq"], mark)

    def merge(self, everything: bool = False) -> None:
        """Makes one of the segments of each full size class, smallest first, or of all."""
        while True:
            segments = self.state["segments"]
            size = lambda s: s["postings"] + s["dead"]
            if everything or sum(s["dead"] for s in segments) > max(FAN, DEAD_SHARE * sum(s["postings"] for s in segments)):
                chosen = segments if len(segments) > 1 or any(s["dead"] for s in segments) else []
            else:
                classes: dict[int, list[dict]] = {}
                for s in segments:
                    classes.setdefault(int(math.log(max(size(s), 1), FAN) + 1e-9), []).append(s)
                chosen = next((classes[c] for c in sorted(classes) if len(classes[c]) >= FAN), [])
            if not chosen:
                return
            self._merge(chosen)
            if everything:
                return

    def _merge(self, chosen: list[dict]) -> None:
        others = [s for s in self.state["segments"] if s not in chosen]
        name = f"segments/{max(s['high'] for s in chosen):012d}-{uuid.uuid4().hex}"
        by_gram(self._alive(self._read("postings", POSTINGS, chosen))).write.parquet(f"{self.path}/{name}/postings")
        self._read("grams", GRAMS, chosen).groupBy("gram", "field").agg(F.sum("df").alias("df")).filter("df <> 0").sortWithinPartitions("gram").write.parquet(f"{self.path}/{name}/grams")
        # A tombstone is needed while a segment elsewhere may hold a posting that it covers.
        oldest = min((s["low"] for s in others), default=math.inf)
        dead = self._read("dead", DEAD, chosen).groupBy("id").agg(F.max("seq").alias("seq"))
        kept = 0
        if oldest < math.inf:
            dead.filter(F.col("seq") > oldest).write.parquet(f"{self.path}/{name}/dead")
            kept = self.spark.read.schema(DEAD).parquet(f"{self.path}/{name}/dead").count()
        sizes: dict[str, list[int]] = {}
        for s in chosen:
            for field, (n, length) in s["sizes"].items():
                own = sizes.setdefault(field, [0, 0])
                own[0], own[1] = own[0] + n, own[1] + length
        alive = sum(s["postings"] for s in chosen) - sum(s["dead"] for s in chosen) + kept
        merged = {"name": name, "low": min(s["low"] for s in chosen), "high": max(s["high"] for s in chosen), "sizes": sizes, "postings": max(alive, 1), "grams": 1, "dead": kept}
        self._commit([*others, merged], self.state["seq"], self.state["mark"])

    def clear(self) -> None:
        """Begins anew, without segments."""
        self._commit([], self.state["seq"], None)

    def vacuum(self) -> None:
        """Deletes manifests but the last, and segments that it doesn't name; searches that began before may fail."""
        names = {s["name"].split("/")[1] for s in self.state["segments"]}
        for x in listed(self.spark, f"{self.path}/segments"):
            if x not in names:
                delete(self.spark, f"{self.path}/segments/{x}")
        for x in listed(self.spark, f"{self.path}/manifest"):
            if x.endswith(".json") and int(x.removesuffix(".json")) < self.version:
                delete(self.spark, f"{self.path}/manifest/{x}")

    # --- what a search reads ---

    @property
    def sizes(self) -> DataFrame:
        total: dict[str, list[int]] = {}
        for s in self.state["segments"]:
            for field, (n, length) in s["sizes"].items():
                own = total.setdefault(field, [0, 0])
                own[0], own[1] = own[0] + n, own[1] + length
        return self.spark.createDataFrame([(f, n, length / n) for f, (n, length) in total.items() if n], "field string, n long, avg_len double")

    def _alive(self, postings: DataFrame) -> DataFrame:
        """Postings that no later tombstone covers."""
        n = sum(s["dead"] for s in self.state["segments"])
        if not n:
            return postings
        gone = self._read("dead", DEAD).groupBy("id").agg(F.max("seq").alias("gone"))
        gone = F.broadcast(gone) if n <= BROADCAST_DEAD else gone
        return postings.join(gone, (postings["id"] == gone["id"]) & (postings["seq"] < gone["gone"]), "left_anti")

    def having(self, grams: DataFrame) -> DataFrame:
        """Live postings, at least those of some grams: of a few grams, the scan reads no others."""
        return self._alive(named(self._read("postings", POSTINGS), few_names(grams))).drop("seq")

    def frequencies(self, grams: DataFrame) -> DataFrame:
        """``gram, field, df`` of some grams."""
        asked = grams.select("gram").distinct()
        moves = named(self._read("grams", GRAMS), few_names(grams)).join(asked, "gram", "left_semi")
        return moves.groupBy("gram", "field").agg(F.sum("df").alias("df")).filter("df > 0")
