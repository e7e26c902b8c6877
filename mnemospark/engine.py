"""One object over a store's tables: add, change, list, delete, recover, search, projects and settings.

Records, vectors and settings are Parquet folders.  Writes append operations, and reads fold them; ``compact`` folds the log once and starts a new generation of it.
One process writes at a time; any number may read.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import MemoryConfig, SearchConfig
from .operators import chunking, embed, search, store
from .operators.segments import SegmentIndex
from .runtime import age, delete, exists, listed, materialise
from .schema import NIL, SCOPES, SOURCES

LOG = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("op", T.StringType()), T.StructField("id", T.StringType()), T.StructField("value", T.StringType())]
)
VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("seq", T.LongType())])
SETTINGS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
EMBEDDINGS = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
ACTIVE, PROJECTS = "active_project", "project:"


class NotFound(LookupError):
    """No record of this id."""


class NotDeleted(ValueError):
    """A record that isn't deleted can't be recovered."""


class Expired(ValueError):
    """The time in which a deleted record can be recovered is over."""


def _fields() -> dict[str, Column]:
    return {"content": F.col("content"), "tags": F.array_join("tags", " ")}


class MemoryEngine:
    def __init__(self, spark: SparkSession, path: str, embedder: embed.Embedder | None = None, config: SearchConfig = SearchConfig(), memory: MemoryConfig = MemoryConfig(), cache_seconds: int = 0):
        """Opens a store; its tables are made if they aren't there.  Hits of a search are kept for ``cache_seconds``; the published program's documents say 300."""
        self.spark, self.path, self.config, self.memory = spark, path.rstrip("/"), config, memory
        self.embedder = embedder or embed.HashingEmbedder()
        self.cache_seconds = cache_seconds
        self._seq = 0
        for name, schema in (("log/00000000", LOG), ("vectors/00000000", VECTORS), ("settings", SETTINGS), (self._embeddings(), EMBEDDINGS)):
            if not exists(spark, f"{self.path}/{name}"):
                spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    # --- tables ---

    def _last(self, table: str) -> str:
        """The folder of a table's last whole generation."""
        whole = [x for x in listed(self.spark, f"{self.path}/{table}") if exists(self.spark, f"{self.path}/{table}/{x}/_SUCCESS")]
        return f"{self.path}/{table}/{max(whole, default='00000000')}"

    def _log(self) -> str:
        return self._last("log")

    def _embeddings(self) -> str:
        """The table of texts that a model has embedded; a model is known by its ``name`` or its class, and its dimension."""
        return f"embeddings/{getattr(self.embedder, 'name', type(self.embedder).__name__)}-{self.embedder.dimension}"

    def _vectors(self) -> str:
        return self._last("vectors")

    def _next(self) -> int:
        """Numbers that grow, in microseconds of time where they can."""
        self._seq = max(self._seq + 1, time.time_ns() // 1000)
        return self._seq

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self._log())

    def _op(self, kind: str, key: str, value: str | None = None) -> None:
        self._append([(self._next(), datetime.now(UTC).replace(tzinfo=None), kind, key, value)])

    def _keep(self, keys: list[str], texts: list[str]) -> None:
        rows = [(k, [float(x) for x in v], self._next()) for k, v in zip(keys, self.embedder.embed(texts), strict=True)]
        store.accepted(self.spark.createDataFrame(rows, VECTORS), self.embedder.dimension).coalesce(1).write.mode("append").parquet(self._vectors())

    def memories(self, key: str | None = None) -> DataFrame:
        """Records, live and hidden; of one id, only its operations are read and folded."""
        log = self.spark.read.schema(LOG).parquet(self._log())
        return self._records(log.filter(F.col("id") == key) if key is not None else log)

    def _records(self, log: DataFrame) -> DataFrame:
        state = store.fold(log)
        flags = state.select("id", F.col("is_deleted").alias("_d"), F.col("deleted_at").alias("_at"), F.col("tags").alias("_tags"))
        rows = store.from_json(state).drop("is_deleted", "deleted_at").join(flags, "id")
        return rows.withColumn("tags", F.array_union("tags", "_tags")).drop("_tags").withColumnsRenamed({"_d": "is_deleted", "_at": "deleted_at"})

    def vectors(self) -> DataFrame:
        """The last vector of each id."""
        rows = self.spark.read.schema(VECTORS).parquet(self._vectors())
        return rows.groupBy("id").agg(F.max_by("embedding", "seq").alias("embedding"))

    # --- records ---

    def add(self, content: str, memory_type: str = "conversation", tags: list[str] | None = None, project: str | None = None, source: str = "user", scope: str = "project", is_global: bool = False) -> list[str]:
        """Ids of the records: one, or one for each part of a long text.  Unknown sources and scopes fall back to the defaults."""
        parts = chunking.split(content) or [""]
        ids, group = [str(uuid.uuid4()) for _ in parts], str(uuid.uuid4())
        now = datetime.now(UTC).replace(tzinfo=None)
        rows = []
        for i, (key, part) in enumerate(zip(ids, parts, strict=True)):
            own, place = list(tags or []), {}
            if len(parts) > 1:
                own += [f"part:{i + 1}-{len(parts)}", *(["part:first"] if i == 0 else []), *(["part:last"] if i + 1 == len(parts) else [])]
                place = {"chunk_group_id": group, "chunk_index": i, "chunk_total": len(parts)}
            record = {
                "id": key, "memory_type": memory_type, "content": part, "tags": own, "project_id": NIL if is_global else project,
                "source": source if source in SOURCES else "user", "scope": scope if scope in SCOPES else "project", "created_at": now.isoformat(), "last_accessed": now.isoformat(), **place,
            }
            rows.append((self._next(), now, "add", key, json.dumps(record)))
        # Vectors first: a wrong dimension leaves no record behind.
        self._keep(ids, parts)
        self._append(rows)
        return ids

    def get(self, key: str) -> DataFrame:
        return self.memories(key)

    def _record(self, key: str, deleted: bool = False) -> dict:
        row = self.memories(key).select(F.to_json(F.struct("*")).alias("value"), "is_deleted", "deleted_at").first()
        if row is None or (row["is_deleted"] and not deleted):
            raise NotFound(key)
        return {"value": json.loads(row["value"]), "deleted_at": row["deleted_at"], "is_deleted": row["is_deleted"]}

    def update(self, key: str, content: str | None = None, tags: list[str] | None = None, memory_type: str | None = None, importance: float | None = None) -> None:
        """Changes what is given of a live record."""
        value = self._record(key)["value"]
        changes = {"content": content, "tags": tags, "memory_type": memory_type, "importance": importance}
        value |= {k: v for k, v in changes.items() if v is not None}
        if content is not None:
            self._keep([key], [content])
        # The whole record is written, so tags that are given take the place of all before.
        self._op("update" if tags is None else "replace", key, json.dumps({k: v for k, v in value.items() if k not in ("is_deleted", "deleted_at")}))

    def add_tag(self, key: str, tag: str) -> None:
        self._record(key)
        self._op("tag", key, tag)

    def delete(self, key: str) -> bool:
        """Hides a record; a second delete removes it.  Whether there was one: a missing id changes nothing."""
        if self.memories(key).isEmpty():
            return False
        self._op("delete", key)
        return True

    def recover(self, key: str) -> None:
        """Shows a hidden record again, within the days that it is kept."""
        state = self._record(key, deleted=True)
        if not state["is_deleted"]:
            raise NotDeleted(key)
        if datetime.now(UTC).replace(tzinfo=None) - state["deleted_at"] > timedelta(days=self.memory.soft_delete_days):
            raise Expired(key)
        self._op("recover", key)

    def list(self, limit: int = 20, **scope) -> DataFrame:
        return store.listed(self.memories(), limit, **scope)

    def stats(self, mode: str = "parity") -> DataFrame:
        return store.stats(self.memories(), mode)

    def compact(self) -> None:
        """Writes the folded state as a new generation of the log, and the last vectors as one of theirs; earlier ones stay for those who read them.

        The text index becomes one segment, and what it no longer needs is deleted."""
        index = self.index()
        old = self._log()
        new = f"{self.path}/log/{int(old.rsplit('/', 1)[1]) + 1:08d}"
        log = self.spark.read.schema(LOG).parquet(old)
        last = log.agg(F.max("seq"), F.max("ts")).first()
        base = int(last[0] or 0)
        state = store.fold(log).withColumn("at", F.coalesce("deleted_at", F.lit(last[1]).cast("timestamp_ntz")))
        op = lambda kind, value, seq: F.struct(F.lit(seq).cast("long").alias("seq"), F.col("at").alias("ts"), F.lit(kind).alias("op"), value.alias("value"))
        # Numbers are compared within an id only: add, tags, delete.
        tags = F.transform("tags", lambda t: F.struct((F.lit(base + 1) + F.array_position("tags", t)).cast("long").alias("seq"), F.col("at").alias("ts"), F.lit("tag").alias("op"), t.alias("value")))
        hidden = F.when(F.col("is_deleted"), F.array(F.struct((F.lit(base + 2) + F.size("tags")).cast("long").alias("seq"), F.col("at").alias("ts"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("value"))))
        ops = F.concat(F.array(op("add", F.col("value"), base + 1)), tags, F.coalesce(hidden, F.slice(tags, 1, 0)))
        rows = state.select("id", F.explode(ops).alias("o")).select("o.seq", "o.ts", "o.op", "id", "o.value")
        rows.write.mode("overwrite").parquet(new)
        # The state is the same, so the text index holds for the new generation too.
        index.change(mark=self._mark())
        index.merge(everything=True)
        index.vacuum()
        self._compact_vectors()
        delete(self.spark, f"{self.path}/results")

    def rebuild_vectors(self) -> int:
        """Embeds the live records that have no vector; a text that was ever embedded so isn't embedded again.  How many there were."""
        rows = store.missing_vectors(self.memories(), self.vectors()).select("id", "content")
        known = f"{self.path}/{self._embeddings()}"
        made, fresh = embed.embedded_once(rows, self.embedder, cache=self.spark.read.schema(EMBEDDINGS).parquet(known).dropDuplicates(["sha256"]))
        fresh.write.mode("append").parquet(known)
        made = store.accepted(made, self.embedder.dimension).select("id", "embedding", F.lit(self._next()).cast("long").alias("seq"))
        before = self.spark.read.schema(VECTORS).parquet(self._vectors()).count()
        made.write.mode("append").parquet(self._vectors())
        return self.spark.read.schema(VECTORS).parquet(self._vectors()).count() - before

    # --- search ---

    def _files(self) -> list:
        """The generation of the log and how many files it has: they are only added, so this tells its state."""
        log = self._log()
        return [log.rsplit("/", 1)[1], sum(x.startswith("part-") for x in listed(self.spark, log))]

    def _mark(self) -> list:
        """What a text index has seen: ``_files`` and the last number."""
        files = self._files()
        return [*files, int(self.spark.read.schema(LOG).parquet(self._log()).agg(F.max("seq")).first()[0] or 0)]

    def index(self) -> SegmentIndex:
        """The text index of the live records, brought up to the log: one segment for all that changed since the last time."""
        index = SegmentIndex(self.spark, f"{self.path}/text", _fields())
        if (index.state["mark"] or [])[:2] == self._files():
            return index
        mark = self._mark()
        if index.state["mark"] and index.state["mark"][0] != mark[0]:
            index.clear()
        seen = (index.state["mark"] or [-1])[-1]
        log = self.spark.read.schema(LOG).parquet(self._log()).filter(F.col("seq") <= mark[-1])
        if seen < 0:
            index.change(store.live(self._records(log)), mark=mark)
            return index
        touched = materialise(log.filter(F.col("seq") > seen).select("id").distinct(), "touched")
        own = log.join(touched, "id", "left_semi")
        # Written, so that both folds are made once.
        old, new = (materialise(store.live(self._records(x)).select("id", "content", "tags"), "changed") for x in (own.filter(F.col("seq") <= seen), own))
        index.change(new, old, mark)
        return index

    def _compact_vectors(self) -> None:
        """Writes the last vector of each record that is still there as a new generation, in files of a useful size."""
        old = self._vectors()
        new = f"{self.path}/vectors/{int(old.rsplit('/', 1)[1]) + 1:08d}"
        last = self.spark.read.schema(VECTORS).parquet(old).groupBy("id").agg(F.max_by(F.struct("embedding", "seq"), "seq").alias("v")).select("id", "v.embedding", "v.seq")
        last.join(self.memories().select("id"), "id", "left_semi").write.mode("overwrite").parquet(new)

    def search(self, text: str, k: int = 10, min_score: float = 0.5, mode: str = "parity", project: str | None = None, as_of: Column | None = None, merge_chunks: bool = False, **flags) -> DataFrame:
        """Hits of one request; with ``merge_chunks`` the parts of a split record are one hit with its whole text.

        With ``cache_seconds`` hits are written and read again while they are younger than that and no record or vector has changed.
        A text that can't be read raises ``search.QueryError``."""
        search.parse(text)
        if not self.cache_seconds:
            return self._search(text, k, min_score, mode, project, as_of, merge_chunks, **flags)
        asked = repr((text, k, min_score, mode, project, str(as_of), merge_chunks, sorted(flags.items()), self.config, self._embeddings(), self._files(), self._vector_files()))
        path = f"{self.path}/results/{hashlib.sha256(asked.encode()).hexdigest()}"
        old = age(self.spark, f"{path}/_SUCCESS")
        if old is None or old > self.cache_seconds:
            # The k hits are one file.
            self._search(text, k, min_score, mode, project, as_of, merge_chunks, **flags).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _vector_files(self) -> list:
        folder = self._vectors()
        return [folder.rsplit("/", 1)[1], sum(x.startswith("part-") for x in listed(self.spark, folder))]

    def _search(self, text: str, k: int, min_score: float, mode: str, project: str | None, as_of: Column | None, merge_chunks: bool, **flags) -> DataFrame:
        wanted, include_global = search.scope_of(project, **flags)
        schema = "qid long, q array<float>, words string, project string, include_global boolean"
        request = self.spark.createDataFrame([(0, [float(x) for x in self.embedder.embed([text])[0]], text, wanted, include_global)], schema)
        m = store.live(self.memories())
        payload = m.select("id", "project_id", "memory_type", "tags")
        hits = search.hybrid(m, self.vectors().join(payload, "id"), request, k, min_score, mode, _fields(), self.config, as_of, self.index())
        return search.merged_hits(hits, m) if merge_chunks else hits

    # --- settings and projects ---

    def _settings(self) -> DataFrame:
        rows = self.spark.read.schema(SETTINGS).parquet(f"{self.path}/settings")
        return rows.groupBy("key").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value")).filter("value is not null")

    def config_get(self, key: str) -> str | None:
        row = self._settings().filter(F.col("key") == key).first()
        return row["value"] if row else None

    def config_set(self, key: str, value: str | None) -> None:
        self.spark.createDataFrame([(self._next(), key, value)], SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    def config_delete(self, key: str) -> None:
        self.config_set(key, None)

    def create_project(self, name: str, root: str | None = None) -> str:
        key = str(uuid.uuid4())
        self.config_set(PROJECTS + key, json.dumps({"name": name, "root": root, "created_at": datetime.now(UTC).isoformat()}))
        return key

    def projects(self) -> DataFrame:
        """``project_id, name, root, created_at, memory_count, last_activity, is_active``."""
        own = self._settings().filter(F.startswith("key", F.lit(PROJECTS))).select(F.substring("key", len(PROJECTS) + 1, 64).alias("project_id"), F.from_json("value", "name string, root string, created_at string").alias("p"))
        out = own.select("project_id", "p.*").join(store.project_counts(self.memories()), "project_id", "left")
        return out.withColumns({"memory_count": F.coalesce("memory_count", F.lit(0)), "is_active": F.col("project_id") == F.lit(self.config_get(ACTIVE) or "")})

    def switch_project(self, key: str) -> None:
        if self.config_get(PROJECTS + key) is None:
            raise NotFound(key)
        self.config_set(ACTIVE, key)

    def active_project(self) -> str | None:
        return self.config_get(ACTIVE)

    def delete_project(self, key: str) -> None:
        """Forgets a project and hides its live records."""
        if self.config_get(PROJECTS + key) is None:
            raise NotFound(key)
        now, seq = datetime.now(UTC).replace(tzinfo=None), self._next()
        rows = store.by_project(self.memories(), key).select(F.lit(seq).cast("long").alias("seq"), F.lit(now).cast("timestamp_ntz").alias("ts"), F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("value"))
        rows.write.mode("append").parquet(self._log())
        self.config_delete(PROJECTS + key)
        if self.active_project() == key:
            self.config_delete(ACTIVE)
