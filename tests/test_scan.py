"""Searches of a batch by scans: the same hits as pair by pair or by an index, with few rows and no postings written."""

import random

import numpy as np
from pyspark.sql import functions as F

from mnemospark.functions import expressions as X
from mnemospark.operators import postings, scan, search
from mnemospark.runtime import against_requests, listed, shared_dir

VECTORS = "id string, embedding array<float>, project_id string"
ASKED = "qid long, q array<double>, own string, project string, include_global boolean"


def key(df, *names):
    return sorted(tuple(r[n] if n != "score" else round(r[n], 8) for n in names) for r in df.collect())


def test_grams_are_counted_by_words():
    rng = random.Random(3)
    grams = ["aa", "aaa", "abab", "ab", "b ", "漢字", "zzzz"]
    texts = ["", " ", "aaaa aaaaa\tabababab", "ab ab", "漢字漢字 b", *("".join(rng.choice("ab \n ") for _ in range(80)) for _ in range(30))]
    for counter in (postings.GramCounter(grams),) * 2:
        assert counter.counts(texts).tolist() == [[t.count(g) for g in grams] for t in texts]


def test_knn_by_matrices(spark, monkeypatch):
    """Ties, vectors of another length, of no length, null and not finite ones, ids that are left out, scopes, and batches of several passes."""
    rng = np.random.default_rng(4)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 4)], f"p{i % 3}") for i in range(150)]
    rows += [("short", [1.0, 2.0], "p0"), ("null", None, "p0"), ("holed", [1.0, None, 0.0, 2.0], "p0"), ("nan", [float("nan")] * 4, "p1"), ("none", [0.0] * 4, "p1")]
    asked = [(i, rows[i][1], rows[i][0], f"p{i % 2}" if i % 5 else None, False) for i in range(12)] + [(99, [1.0, 1.0], "v000", None, True)]
    v, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, ASKED)
    monkeypatch.setattr(scan, "PASS", 5)

    def plain(where, least):
        cos = lambda both: both.select("qid", "id", F.round(X.cosine(F.col("embedding"), F.col("q")), 9).alias("score")).filter(F.col("score") >= least)
        return key(search.top(against_requests(v, q, where, cos), 7, ["qid"]).select("qid", "id", F.coalesce(F.nanvl("score", F.lit(9.0))).alias("score"), "rank"), "qid", "id", "score", "rank")

    fine = lambda df: key(df.select("qid", "id", F.nanvl("score", F.lit(9.0)).alias("score"), "rank"), "qid", "id", "score", "rank")
    assert fine(search.knn(v, q, 7, -1.0, apart="own")) == plain(F.col("id") != F.col("own"), -1.0)
    assert fine(search.knn(v, q, 7, 0.2, search.in_vector_scope)) == plain(search.in_vector_scope(), 0.2)


def test_sets_by_counts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"d{i:03d}", sorted(rng.sample("abcdefgh", rng.randrange(0, 5)))) for i in range(120)] + [("null", None)]
    t = spark.createDataFrame(rows, "id string, t array<string>").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    asked = t.filter("id < 'd015'").select(F.col("id").alias("a"), F.col("t").alias("u"))
    monkeypatch.setattr(scan, "PASS", 4)
    want = against_requests(t, asked, F.col("a") != F.col("id"), lambda both: search.top(both.select("a", "id", F.round(X.jaccard(F.col("u"), F.col("t")), 6).alias("score")), 5, ["a"]))
    got = search.top(scan.jaccard_best(t, asked, 5).withColumn("score", F.round("score", 6)), 5, ["a"])
    assert key(got, "a", "id", "score", "rank") == key(want, "a", "id", "score", "rank")


def test_text_search_writes_no_postings(spark):
    """Hits of a batch come without an index, and what a task hands on is a request's best, not all that match."""
    docs = spark.createDataFrame([(f"d{i:04d}", f"common word {'rare' if i % 97 == 0 else 'x' * (i % 50)}", "p", "note") for i in range(3000)], "id string, content string, project_id string, memory_type string")
    requests = spark.createDataFrame([(1, "common word rare", None, True), (2, "common", None, True)], "qid long, words string, project string, include_global boolean")
    fields = {"content": F.col("content")}
    before = set(listed(spark, f"{shared_dir(spark)}/mnemospark"))
    got = key(search.text_search(docs, requests, 10), "qid", "id", "score", "rank")
    made = set(listed(spark, f"{shared_dir(spark)}/mnemospark")) - before
    assert made and not [x for x in made if x.startswith("index-")]
    (hits,) = [x for x in made if x.startswith("hits-")]
    assert spark.read.parquet(f"{shared_dir(spark)}/mnemospark/{hits}").count() <= 2 * 10 * 8
    assert got == key(search.top(search.bm25(postings.TextIndex.of(docs, fields), requests), 10, ["qid"]), "qid", "id", "score", "rank")


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A table of as many files as cores isn't dealt anew by a scan; one of a single file is."""
    from mnemospark import runtime

    monkeypatch.setattr(runtime, "TINY", 0)
    rows = spark.range(800).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("text "), 9).alias("content"))
    for files in (1, 8):
        rows.repartition(files).write.parquet(f"{tmp_path}/{files}")
    # Some bytes of each file suffice for a task of its own.
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)
    try:
        plan = lambda n: scan.spread(spark.read.parquet(f"{tmp_path}/{n}").select("id", F.lower("content").alias("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan(1) and "Repartition" not in plan(8)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_words_in_passes(spark, monkeypatch):
    """More words than a pass has: the texts are scanned again, no index is made."""
    docs = spark.createDataFrame([(f"d{i:03d}", f"w{i % 7} v{i % 5} u{i % 3}" * (1 + i % 4), f"p{i % 2}", "note") for i in range(200)], "id string, content string, project_id string, memory_type string")
    requests = spark.createDataFrame([(i, f"w{i % 7} v{i % 5}", f"p{i % 2}" if i % 3 else None, False) for i in range(12)], "qid long, words string, project string, include_global boolean")
    found = lambda mode: key(search.text_search(docs, requests, 4, mode=mode, keep=search.in_text_scope()), "qid", "id", "score", "rank")
    want = [found(m) for m in ("parity", "corrected")]
    monkeypatch.setattr(search, "WORDS", 5)
    before = set(listed(spark, f"{shared_dir(spark)}/mnemospark"))
    assert [found(m) for m in ("parity", "corrected")] == want and all(want)
    assert not [x for x in set(listed(spark, f"{shared_dir(spark)}/mnemospark")) - before if x.startswith("index-")]


def test_records_of_searches_need_no_join(spark, tmp_path):
    """Texts meet no other table, unless a document has several labels: then it is several records, as in the whole table."""
    from mnemospark.sources import fixtures as fx

    spark.createDataFrame([(i, f"text {i}", "en", "src1") for i in range(6)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select timestamp_ntz'2024-01-01' as ts, 1L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    for labels, joins in (([(1, 0), (2, 1), (None, 1), (None, 0)], False), ([(1, 0), (1, 1), (2, 1)], True)):
        spark.createDataFrame(labels, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        few, whole = fx.memories(spark, str(tmp_path), whole=False), fx.memories(spark, str(tmp_path))
        assert ("Join" in few._jdf.queryExecution().optimizedPlan().toString()) == joins
        assert key(few, "id", "content", "importance") == key(whole, "id", "content", "importance")
