"""Indexes made for a batch of requests hold its grams alone and find the same."""

from pyspark.sql import functions as F

from mnemospark.operators import impacts, postings, search, segments


def test_only_the_grams_of_the_batch_are_written(spark, tmp_path):
    rows = [(f"d{i:02d}", f"alpha beta{'s' * (i % 3)} unasked words {i}" if i % 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "id string, content string")
    requests = spark.createDataFrame([(1, "beta alpha"), (2, "betas zz")], "qid long, words string")
    fields = {"content": F.col("content")}
    grams = postings.grams_of(search.request_words(requests))
    key = lambda df: sorted((r["qid"], r["id"], round(r["score"], 7)) for r in df.select("qid", "id", "score").collect())
    index = impacts.ImpactIndex.build(docs, fields, str(tmp_path / "i"), grams)
    assert {r["gram"] for r in index.postings.select("gram").distinct().collect()} <= set(grams)
    want = key(search.text_search(docs, requests, 5, fields))
    assert key(search.bounded_bm25(index, requests, 5)) == want and want
    changing = segments.SegmentIndex(spark, str(tmp_path / "s"), fields, grams)
    changing.change(docs)
    assert key(search.top(search.bm25(changing, requests), 5, ["qid"])) == want
