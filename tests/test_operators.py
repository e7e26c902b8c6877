import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark import config, runtime
from mnemospark.engine import Expired, MemoryEngine, NotDeleted, NotFound
from mnemospark.functions import expressions as X
from mnemospark.operators import chunking, clusters, embed, postings, search, segments, store
from mnemospark.schema import NIL
from mnemospark.sources import files, fixtures
from mnemospark.streaming import ingest

REQUEST = "qid long, q array<float>, words string, project string, include_global boolean"


def test_knn_order(spark):
    v = spark.createDataFrame([("near", [3.0, 4.0]), ("nearer", [6.0, 8.5]), ("across", [-4.0, 3.0]), ("none", [0.0, 0.0]), ("away", [-3.0, -4.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [0.6, 0.8], "", None, False), (1, [-1.0, 0.0], "", None, False)], REQUEST)
    got = {(r["qid"], r["rank"]): (r["id"], round(r["score"], 6)) for r in search.knn(v, q, 2, 0.5).collect()}
    assert got == {(0, 1): ("near", 1.0), (0, 2): ("nearer", round(10.4 / math.hypot(6.0, 8.5), 6)), (1, 1): ("across", 0.8), (1, 2): ("away", 0.6)}


def _mmr(spark, rows, **args):
    df = spark.createDataFrame([(0, str(i), float(s), t) for i, (t, s) in enumerate(rows)], "qid long, id string, score double, text string")
    return [int(r["id"]) for r in search.mmr(df, **args).orderBy("rank").collect()]


def test_mmr(spark):
    rows = [("red apple pie", 0.95), ("red apple tart", 0.9), ("green pear", 0.7), ("apple pie red", 0.94), ("blue", 0.1)]
    # Against a plain greedy choice.
    words = [set(t.split()) for t, _ in rows]
    for lam in (0.2, 0.5, 0.9, 1.0):
        left, done = sorted(range(5), key=lambda i: -rows[i][1]), []
        while left and len(done) < 4:
            gain = lambda i: round(lam * rows[i][1] - (1 - lam) * max([0, *(len(words[i] & words[j]) / len(words[i] | words[j]) for j in done)]), 9)  # noqa: E731, B023
            best = max(left, key=gain)
            left.remove(best)
            done.append(best)
        assert _mmr(spark, rows, lam=lam, k=4) == done
    assert len(_mmr(spark, [(f"text {i}", 1 / (i + 1)) for i in range(30)], k=10, candidates=6)) == 6
    assert _mmr(spark, [], k=3) == []


def test_fusion_directions(spark):
    v = spark.createDataFrame([(0, "a", 0.9), (0, "b", 0.5)], "qid long, id string, score double")
    t = spark.createDataFrame([(0, "b", 3.0)], "qid long, id string, score double")
    parity = {r["id"]: r["score"] for r in search.fuse(v, t).collect()}
    assert parity == {"a": 0.0, "b": 1.0}
    corrected = {r["id"]: r["score"] for r in search.fuse(v, t, mode="corrected").collect()}
    assert corrected == {"a": 0.5, "b": 0.5}


def test_decay_and_weights(spark):
    rows = [("project", "user", 336, 0.5), ("global", "user", 1000, 1.0), ("global", "inferred", 1000, 0.5), ("workspace", "external", 5, 0.7)]
    df = spark.createDataFrame(rows, "scope string, source string, hours int, want double")
    at = fixtures.as_of()
    got = df.select("want", X.applied_score(F.lit(1.0), at - F.make_dt_interval(hours=F.col("hours")), F.col("scope"), F.col("source"), at).alias("s")).collect()
    assert all(math.isclose(r["s"], r["want"], abs_tol=1e-9) for r in got)
    custom = config.SearchConfig(weights=config.SourceWeights(1.0, 0.9, 0.6, 0.8))
    assert spark.range(1).select(X.source_weight(F.lit("system"), custom)).first()[0] == 0.9


def test_importance(spark):
    df = spark.range(1).select(F.array(F.lit("critical")).alias("t"), F.create_map().cast("map<string,string>").alias("m"))
    at = fixtures.as_of()
    assert math.isclose(df.select(X.importance(F.col("t"), F.col("m"), at, F.lit(0), at)).first()[0], 0.65)
    for raw, want in (("1f", 0.65), (" 0.5 ", 0.65), ("2", 1.0), ("-5", 0.0), ("0.25", 0.575)):
        m = F.create_map(F.lit("priority"), F.lit(raw))
        assert math.isclose(df.select(X.importance(F.col("t"), m, at, F.lit(0), at)).first()[0], want), raw


def test_fold_is_order_free(spark):
    log = [(1, "add", "a", "x"), (2, "delete", "a", None), (3, "delete", "a", None), (4, "add", "a", "y"), (5, "tag", "a", "t"), (6, "add", "b", "z"), (7, "delete", "b", None), (8, "add", "c", "w"), (9, "delete", "c", None), (10, "delete", "c", None)]
    log += [(11, "add", "d", "v"), (12, "delete", "d", None), (13, "recover", "d", None), (14, "update", "d", "u"), (15, "add", "e", "s"), (16, "delete", "e", None), (17, "recover", "e", None), (18, "delete", "e", None)]
    df = spark.createDataFrame(log[::-1] + log[:3], "seq long, op string, id string, value string").withColumn("ts", fixtures.as_of())
    got = {r["id"]: (r["value"], r["tags"], r["is_deleted"]) for r in store.fold(df).collect()}
    assert got == {"a": ("y", ["t"], False), "b": ("z", [], True), "d": ("u", [], False), "e": ("s", [], True)}
    # Both views of a log agree.
    state = {r["id"]: r["state"] for r in store.delete_state(df).collect()}
    assert state == {"a": "live", "b": "soft", "c": "hard", "d": "live", "e": "soft"}


def _plain_split(text, size):
    """Character by character: the longest head that fits, back to the end of its last sentence of the first kind that there is."""
    out = []
    while text:
        n, used = 0, 0
        while n < len(text) and used + len(text[n].encode()) <= size:
            used += len(text[n].encode())
            n += 1
        if n < len(text):
            head = text[:n]
            for mark in "？！。\n?!.":
                at = head.rfind(mark)
                if at >= 0 and len(head[: at + 1].encode()) > chunking.MIN_BYTES:
                    n = at + 1
                    break
        n = max(n, 1)
        out.append(text[:n])
        text = text[n:]
    return out


def test_chunks():
    rng = random.Random(3)
    letters = "abé漢 .!?。！？\n" + "x" * 40
    for size in (1200, chunking.MAX_BYTES):
        for n in (0, 1, 500, 3000, 20000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert chunking.split(text, size) == _plain_split(text, size)
    for text in ("z" * 16000, "語" * 5000, "Wort. " * 3000, "é" * 7501, "語。" * 3000 + "b!" * 3000):
        assert chunking.split(text) == _plain_split(text, chunking.MAX_BYTES) and "".join(chunking.split(text)) == text


def test_chunk_table(spark):
    texts = {"a": "one. " * 4000, "b": "", "c": None, "d": "short"}
    got = chunking.chunk(spark.createDataFrame(list(texts.items()), "id string, content string")).collect()
    want = [(i, k + 1, len(p), x) for i, t in texts.items() for p in [_plain_split(t or "", chunking.MAX_BYTES)] for k, x in enumerate(p)]
    assert sorted((r["id"], r["part"], r["total"], r["content"]) for r in got) == sorted(want)


def test_embedder(spark):
    """Signed counts of words by their digests, of unit length; a text is embedded once, and not if a cache has it."""
    own = embed.HashingEmbedder(8)

    def plain(text):
        v = [0.0] * 8
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[(h >> 1) % 8] += 1 if h & 1 else -1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    rows = [("a", "One two TWO three"), ("b", "one TWO two three"), ("c", ""), ("d", None), ("e", "One two TWO three")]
    df = spark.createDataFrame(rows, "id string, content string")
    got, fresh = embed.embedded_once(df, own)
    assert fresh.count() == 3
    for r in got.collect():
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(r["embedding"], plain(dict(rows)[r["id"]] or ""), strict=True))
    again, none = embed.embedded_once(df, own, cache=fresh)
    assert none.count() == 0 and again.count() == 5


def test_part_tags(spark):
    got = spark.range(1, 4).select(store.part_tags(F.array(F.lit("k")), F.col("id"), F.lit(3)).alias("t")).collect()
    assert [r["t"] for r in got] == [["k", "part:1-3", "part:first"], ["k", "part:2-3"], ["k", "part:3-3", "part:last"]]


def test_dimension_error(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        store.accepted(v, 3).collect()


def test_json_defaults(spark):
    got = store.from_json(spark.createDataFrame([('{"id":"a","content":"c"}',), ("no json",)], "value string")).collect()
    assert len(got) == 1 and (got[0]["source"], got[0]["scope"], got[0]["tags"], got[0]["access_count"]) == ("user", "project", [], 0)


def test_scopes():
    assert search.scope_of("p") == ("p", True)
    assert search.scope_of("p", project_only=True) == ("p", False)
    assert search.scope_of("p", global_only=True) == (NIL, True)
    assert search.scope_of("p", cross_project=True) == (None, False)


def test_project_files(spark, tmp_path):
    (tmp_path / "a").write_text("x_project_id=1\ncreated_at = 2024\nproject_name=a=b\n")
    (tmp_path / "b").write_text("x_project_id=1\n")
    got = files.read_project_files(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["project_name"] == "a=b"


def test_project_detection(spark, tmp_path):
    inner = tmp_path / "repo" / "src" / "deep"
    inner.mkdir(parents=True)
    (tmp_path / "repo" / ".git").mkdir()
    assert files.detect_project(inner, create=False) is None
    made = files.detect_project(inner)
    assert made["root"] == str(tmp_path / "repo") and files.detect_project(tmp_path / "repo" / "src") == made
    path = files.write_project_file(tmp_path / "repo", "p1", "2024-01-01", "a=b")
    assert files.detect_project(inner) == {"project_id": "p1", "created_at": "2024-01-01", "project_name": "a=b", "root": str(tmp_path / "repo")}
    assert [(r["project_id"], r["project_name"]) for r in files.read_project_files(spark, str(path)).collect()] == [("p1", "a=b")]
    path.write_text("project_name=x\n")
    with pytest.raises(ValueError):
        files.detect_project(inner)


def test_greedy_clusters(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.3]), ("c", [0.6, 0.8]), ("d", [0.0, 1.0]), ("e", [1.0, 0.01])], "id string, embedding array<float>")
    got = {r["id"]: r["head"] for r in clusters.greedy_clusters(v, 0.75).collect()}
    assert got == {"a": "a", "b": "a", "e": "a", "c": "c", "d": "c"}


def test_requests_beyond_a_batch(spark, monkeypatch):
    from mnemospark import runtime

    rows, req = spark.range(7).withColumnRenamed("id", "r"), spark.range(10).withColumnRenamed("id", "q")
    monkeypatch.setattr(runtime, "BATCH", 3)
    assert runtime.against_requests(rows, req, F.col("r") < F.col("q")).count() == sum(min(q, 7) for q in range(10))
    assert runtime.against_requests(rows, req).count() == 70


def test_grams_of_texts():
    rng = random.Random(1)
    for text in ["", "a", "aaaa", "ababab", "né né", "漢字漢字", *("".join(rng.choice("ab é") for _ in range(60)) for _ in range(20)), "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]:
        grams, tf = postings.gram_counts(text)
        want = {text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)}
        assert len(grams) == len(set(grams)) and dict(zip(grams, tf, strict=True)) == {g: text.count(g) for g in want}


def test_text_index(spark, tmp_path, monkeypatch):
    """Written once, reused while its files are the same; scores are the same whether grams are named, broadcast or joined."""
    rows = [("a", "Alpha beta beta", ["x"]), ("b", "alphabet soup", []), ("c", None, ["beta"]), ("d", "gamma", ["alpha"])]
    spark.createDataFrame(rows, "id string, content string, tags array<string>").write.parquet(str(tmp_path / "t"))
    docs, fields = spark.read.parquet(str(tmp_path / "t")), {"content": F.col("content"), "tags": F.array_join("tags", " ")}
    first = postings.TextIndex.of(docs, fields)
    assert postings.TextIndex.of(spark.read.parquet(str(tmp_path / "t")), fields).path == first.path
    req = spark.createDataFrame([(0, None, "ALPHA beta", None, True), (1, None, "zz q", None, True)], REQUEST)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(search.bm25(first, req))
    assert [r[1] for r in got] == ["a", "b", "c", "d"] and {r[0] for r in got} == {0}
    monkeypatch.setattr(search, "WORDS", 0)
    monkeypatch.setattr(postings, "NAMED", 0)
    assert key(search.bm25(first, req)) == got
    docs.limit(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert postings.TextIndex.of(spark.read.parquet(str(tmp_path / "t")), fields).path != first.path


def test_query_errors():
    assert search.parse("Two words (in all) \"quoted\"") == ["two", "words", "(in", "all)", '"quoted"']
    assert search.parse('6" disk') == ['6"', "disk"] and search.parse("") == []
    with pytest.raises(search.QueryError):
        search.parse(None)


def test_similar_pairs_in_blocks(spark, monkeypatch):
    """Blocks that can't hold a similar pair never meet, and none is lost."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(20, 16)) for c in centres] + [np.zeros((2, 16))]).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03d}", [float(y) for y in r]) for i, r in enumerate(x)], "id string, embedding array<float>")
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1, keepdims=True)).astype(np.float64)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 15)
    for threshold in (0.85, -0.1):
        cos = unit @ unit.T
        sure = {(f"v{i:03d}", f"v{j:03d}") for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] > threshold + 1e-6}
        maybe = {(f"v{i:03d}", f"v{j:03d}") for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] > threshold - 1e-6}
        got = [(r["a"], r["b"]) for r in clusters.similar_pairs(df, threshold).collect()]
        assert len(got) == len(set(got)) and sure <= set(got) <= maybe
    monkeypatch.setattr(clusters, "MET", 0)
    assert len(clusters.similar_pairs(df, 0.85).collect()) == len([1 for i in range(len(x)) for j in range(i + 1, len(x)) if (unit @ unit.T)[i, j] > 0.85])


def test_shared_dir_off_this_machine():
    from types import SimpleNamespace

    from mnemospark import runtime

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(far)


def test_clear(spark):
    from mnemospark import runtime

    df = runtime.materialise(spark.range(3), "x")
    assert df.count() == 3
    folder = runtime.shared_dir(spark) + "/mnemospark"
    runtime.clear(spark)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_settings(tmp_path):
    s = config.load(tmp_path / "c.toml")
    assert s.model.dimension == 384 and (tmp_path / "c.toml").exists()
    (tmp_path / "c.toml").write_text('[model]\nname = "own"\ndimension = 12\n')
    assert config.load(tmp_path / "c.toml").model.dimension == 12


def test_stream_equals_batch(spark, tmp_path):
    log = fixtures.oplog(spark, "/root/testdata/sf0.001")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), log.schema, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ingest.current(spark, str(tmp_path / "log"))) == key(store.fold(log))


def test_access_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    e.unionByName(e).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = ingest.accesses(stream, late="40 days").writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").agg(F.sum("access_count")).first()[0] == e.count()


def test_engine(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "store"))
    assert m.stats().first()["total"] == 0 and m.search("nothing here").collect() == []  # a new store is empty, not an error
    a = m.add("machine learning algorithms", tags=["ml"])[0]
    b = m.add("deep neural networks", project="p")[0]
    m.add("x" * 8000)
    assert m.stats().first()["active"] == 4
    assert [r["id"] for r in m.search("machine learning", min_score=0.1, cross_project=True).collect()][0] in (a, b)
    m.delete(b)
    assert m.get(b).first()["is_deleted"] and m.stats().first()["deleted"] == 1
    assert m.delete(b) and not m.delete(b) and not m.delete("no")
    assert m.get(b).first() is None
    assert m.search('6" (disk').count() >= 0


def test_engine_changes(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "store"))
    a, b = m.add("first text about rivers", tags=["one"])[0], m.add("second text about hills")[0]
    m.update(a, content="new text about lakes", importance=0.4)
    m.add_tag(a, "two")
    m.add_tag(a, "two")
    r = m.get(a).first()
    assert (r["content"], r["tags"], round(r["importance"], 6)) == ("new text about lakes", ["one", "two"], 0.4)
    hit = m.search("lakes", min_score=0.1, cross_project=True, mode="corrected").first()
    assert hit["id"] == a and hit["tags"] == ["one", "two"] and hit["is_chunked"] is False and m.vectors().count() == 2
    for wrong, error in ((lambda: m.update("no", content="x"), NotFound), (lambda: m.recover("no"), NotFound), (lambda: m.recover(b), NotDeleted), (lambda: m.search(None), search.QueryError)):
        with pytest.raises(error):
            wrong()
    m.delete(b)
    with pytest.raises(NotFound):
        m.add_tag(b, "x")
    m.recover(b)
    assert not m.get(b).first()["is_deleted"]
    m.delete(b)
    with pytest.raises(Expired):
        MemoryEngine(spark, str(tmp_path / "store"), memory=config.MemoryConfig(soft_delete_days=-1)).recover(b)
    key = lambda: sorted((r["id"], r["content"], tuple(r["tags"]), r["is_deleted"], str(r["deleted_at"])) for r in m.memories().collect())
    before = key()
    m.compact()
    assert key() == before and m._log().endswith("00000001")
    m.recover(b)
    m.add_tag(b, "late")
    assert m.get(b).first()["tags"] == ["late"] and not m.get(b).first()["is_deleted"]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in m.get(b)._jdf.queryExecution().toString()


def test_engine_tags_after_update(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "store"))
    a = m.add("text", tags=["a"])[0]
    m.add_tag(a, "y")
    m.update(a, tags=["x"])
    assert m.get(a).first()["tags"] == ["x"]
    m.add_tag(a, "z")
    m.update(a, content="other")
    assert sorted(m.get(a).first()["tags"]) == ["x", "z"]
    m.compact()
    m.update(a, tags=[])
    assert m.get(a).first()["tags"] == []


def test_engine_index_follows(spark, tmp_path):
    """Each search adds one segment for what changed; a rebuild finds the same, and a compaction leaves one segment and one vector a record."""
    m = MemoryEngine(spark, str(tmp_path / "store"))
    a, b, c = (m.add(t, tags=["tag"])[0] for t in ("alpha river", "beta river", "gamma hills"))
    key = lambda: sorted((r["id"], r["score"]) for r in search.bm25(m.index(), spark.createDataFrame([(0, None, "river alpha tag", None, True)], REQUEST)).collect())

    def rebuilt():
        docs = [r for r in m.memories().collect() if not r["is_deleted"]]
        df = spark.createDataFrame([(r["id"], r["content"], r["tags"]) for r in docs], "id string, content string, tags array<string>")
        index = segments.SegmentIndex(spark, str(tmp_path / f"whole{len(list(tmp_path.iterdir()))}"), {"content": F.col("content"), "tags": F.array_join("tags", " ")})
        index.change(df)
        return sorted((r["id"], r["score"]) for r in search.bm25(index, spark.createDataFrame([(0, None, "river alpha tag", None, True)], REQUEST)).collect())

    assert {k for k, _ in key()} == {a, b, c}
    m.update(b, content="beta alpha")
    m.delete(a)
    found = key()
    assert found == rebuilt() and {k for k, _ in found} == {b, c}
    n = len(m.index().state["segments"])
    m.recover(a)
    m.update(c, tags=["other"])
    m.compact()
    assert {k for k, _ in key()} == {a, b} and n >= 1
    assert len(m.index().state["segments"]) == 1 and len(list((tmp_path / "store/text/segments").iterdir())) == 1
    assert spark.read.parquet(m._vectors()).count() == 3


def test_engine_caches(spark, tmp_path, monkeypatch):
    """A repeated search reads no postings until a record changes or its time is over; a text is embedded once, whatever record it belongs to."""
    m = MemoryEngine(spark, str(tmp_path / "store"), cache_seconds=300)
    a = m.add("alpha river")[0]
    ask = lambda: [r["id"] for r in m.search("alpha", min_score=0.0, cross_project=True).collect()]
    assert ask() == [a]
    with monkeypatch.context() as p:
        p.setattr(m, "index", lambda: pytest.fail("the index was read"))
        assert ask() == [a]
        p.setattr(m, "cache_seconds", -1)
        with pytest.raises(BaseException, match="index was read"):
            ask()
    m._op("add", "b", '{"id": "b", "content": "alpha hills", "tags": []}')
    assert set(ask()) == {a, "b"}
    m._op("add", "c", '{"id": "c", "content": "alpha hills", "tags": []}')
    asked = []
    monkeypatch.setattr(embed, "embedded", lambda rows, *args, f=embed.embedded: (asked.append(rows.count()), f(rows, *args))[1])
    assert m.rebuild_vectors() == 2
    m._op("add", "d", '{"id": "d", "content": "alpha hills", "tags": []}')
    assert m.rebuild_vectors() == 1 and asked == [1, 0]
    v = {r["id"]: r["embedding"] for r in m.vectors().collect()}
    assert v["b"] == v["c"] == v["d"]


def test_segments_equal_a_rebuild(spark, tmp_path):
    """After a hundred random adds, changes and removals, in batches, frequencies, sizes, postings and scores are those of an index made at once."""
    rng = random.Random(8)
    words = ["ab", "abc", "river", "rivers", "hill", "ürban", "aaaa", "x", ""]
    fields = {"content": F.col("content"), "note": F.col("note")}
    schema = "id string, content string, note string"
    index, held = segments.SegmentIndex(spark, str(tmp_path / "s"), fields), {}
    assert search.bm25(index, spark.createDataFrame([(0, None, "river", None, True)], REQUEST)).count() == 0
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    for _ in range(8):
        added, removed = {}, {}
        for _ in range(13):
            key = f"m{rng.randrange(25)}"
            if key in added or key in removed:
                continue
            if key in held:
                removed[key] = held[key]
            if key not in held or rng.random() < 0.6:
                added[key] = (text(), text())
        held = {k: v for k, v in held.items() if k not in removed} | added
        rows = [spark.createDataFrame([(k, *v) for k, v in x.items()], schema) if x else None for x in (added, removed)]
        index.change(*rows)
    whole = segments.SegmentIndex(spark, str(tmp_path / "w"), fields)
    whole.change(spark.createDataFrame([(k, *v) for k, v in held.items()], schema))
    req = spark.createDataFrame([(0, None, "river abc", None, True), (1, None, "ürban aaaa hills", None, True)], REQUEST)
    key = lambda df: sorted(map(tuple, df.collect()))
    every = spark.createDataFrame([(g,) for g in sorted({w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1)})], "gram string")
    for _ in range(2):
        assert len(index.state["segments"]) <= 7
        assert key(index.sizes) == key(whole.sizes)
        assert key(index.frequencies(every)) == key(whole.frequencies(every))
        assert key(index.having(every).filter("gram is not null")) == key(whole.having(every))
        assert key(search.bm25(index, req)) == key(search.bm25(whole, req))
        index.merge(everything=True)
        assert len(index.state["segments"]) == 1 and not index.state["segments"][0]["dead"]
    index.vacuum()
    assert len(list((tmp_path / "s/segments").iterdir())) == 1
    assert key(search.bm25(segments.SegmentIndex(spark, str(tmp_path / "s"), fields), req)) == key(search.bm25(whole, req))
    # Of two writers that saw the same state, one fails.
    one, two = (segments.SegmentIndex(spark, str(tmp_path / "w"), fields) for _ in range(2))
    row = spark.createDataFrame([("new", "river", None)], schema)
    one.change(row)
    with pytest.raises(runtime.Conflict):
        two.change(row)


def test_engine_vectors_and_chunks(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "store"))
    ids = m.add("river bank. " * 1200, tags=["t"])
    other = m.add("mountain")[0]
    assert len(ids) == 2
    hits = m.search("river", k=5, min_score=0.1, cross_project=True, mode="corrected").collect()
    assert {r["id"] for r in hits} >= set(ids) and all(r["is_chunked"] == (r["id"] in ids) for r in hits)
    merged = m.search("river", k=5, min_score=0.1, cross_project=True, mode="corrected", merge_chunks=True).collect()
    one = [r for r in merged if r["is_chunked"]]
    assert len(one) == 1 and one[0]["content"].count("river") == 1200 and [r["rank"] for r in sorted(merged, key=lambda r: r["rank"])] == list(range(1, len(merged) + 1))
    # A record without a vector, as after an import.
    m._op("add", "lost", '{"id": "lost", "content": "mountain", "tags": []}')
    assert m.rebuild_vectors() == 1 and m.rebuild_vectors() == 0
    v = {r["id"]: r["embedding"] for r in m.vectors().collect()}
    assert v["lost"] == v[other]

    class Short:
        dimension = 64

        def embed(self, texts):
            return embed.HashingEmbedder(3).embed(texts)

    with pytest.raises(Exception, match="dimension mismatch"):
        MemoryEngine(spark, str(tmp_path / "store"), Short()).add("wrong")
    assert m.stats().first()["total"] == 4


def test_engine_projects_and_settings(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "store"))
    assert m.config_get("x") is None
    m.config_set("x", "1")
    m.config_set("x", "2")
    assert m.config_get("x") == "2"
    m.config_delete("x")
    assert m.config_get("x") is None
    p, q = m.create_project("alpha", "/r"), m.create_project("beta")
    key = m.add("text", project=p)[0]
    m.switch_project(p)
    got = {r["name"]: (r["memory_count"], r["is_active"]) for r in m.projects().collect()}
    assert got == {"alpha": (1, True), "beta": (0, False)} and m.active_project() == p
    with pytest.raises(NotFound):
        m.switch_project("no")
    m.delete_project(p)
    assert m.active_project() is None and m.get(key).first()["is_deleted"] and [r["project_id"] for r in m.projects().collect()] == [q]
