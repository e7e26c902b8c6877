"""Top k by bounds against the whole search, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import impacts, postings, search

DOCS = "id string, content string, tags array<string>, project_id string, memory_type string, bound double, level int, gram string"
REQUEST = "qid long, words string, project string, include_global boolean"


def corpus(n: int, seed: int = 5) -> list[tuple]:
    """Texts of Zipf words and of many lengths; copies, so that scores tie; nulls and empty texts.  Three columns are named like the index's own."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ri", "sto", "al", "me") for b in ("ver", "ne", "pha", "mo") for c in ("", "s", "ry")]
    rows = []
    for i in range(n):
        size = rng.choice((1, 4, 30, 200))
        text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=size))
        if i % 7 == 0 and i:
            text = rows[-1][1]
        rows.append((f"d{i:05d}", None if i % 41 == 0 else "" if i % 43 == 0 else text, [rng.choice(words)] if i % 3 else None, f"p{i % 3}", "note", 0.5, 1, "x"))
    return rows


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("impacts"))
    spark.createDataFrame(corpus(600), DOCS).write.parquet(f"{path}/t")
    docs = spark.read.parquet(f"{path}/t")
    fields = {"content": F.col("content"), "tags": F.array_join("tags", " ")}
    asked = ["rivers", "stones alphas memory", "river river al", "zz nothing", "memos q", "a", "stonery rivermo", "ver ne", "", "RIVER stone ALPHA memo rivers stones", None]
    requests = spark.createDataFrame([(i, w, f"p{i % 3}", False) for i, w in enumerate(asked)], REQUEST)
    return docs, fields, requests, impacts.ImpactIndex.build(docs, fields, f"{path}/i")


def key(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize(("first", "few", "k"), [(64, True, 10), (4, False, 25)])
def test_bounded_is_exact(made, monkeypatch, first, few, k):
    """The same hits, scores and ranks, whatever is read first and whether or not grams and ids are named."""
    _, _, requests, index = made
    monkeypatch.setattr(search, "FIRST", first)
    if not few:
        monkeypatch.setattr(search, "TRIED", 1)
        monkeypatch.setattr(impacts, "NAMED", 0)
        monkeypatch.setattr(postings, "NAMED", 0)
    got = key(search.bounded_bm25(index, requests, k))
    assert got == key(search.top(search.bm25(index, requests), k, ["qid"])) and len(got) > 5 * k


def test_filters_before_and_after_the_cut(made):
    docs, fields, requests, index = made
    for mode in ("parity", "corrected"):
        got = search.text_search(docs, requests, 10, mode=mode, keep=search.in_text_scope(), index=index)
        want = search.text_search(docs, requests, 10, fields, mode, search.in_text_scope())
        assert key(got) == key(want) and got.count()


def test_common_grams_are_read_in_part(spark, tmp_path):
    """Of the postings of a common word less than a tenth is read, and the scan of the first pass reads only its best levels."""
    rng = random.Random(9)
    rows = [(f"d{i:06d}", " ".join(["river"] * rng.choice((1, 1, 1, 2, 3)) + ["stone"] * rng.choice((0, 1)) + [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(5, 400))])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id string, content string")
    index = impacts.ImpactIndex.build(docs, {"content": F.col("content")}, str(tmp_path / "i"))
    requests = spark.createDataFrame([(0, "river", None, True), (1, "river stone", None, True)], REQUEST)
    asked, blocks = search.clauses(index, requests)
    levels = search.first_levels(asked, blocks)
    whole = {(r["gram"], r["field"]): r["df"] for r in index.grams.collect()}
    first = index.blocks.join(levels, ["gram", "field"]).filter("level >= low").agg(F.sum("n")).first()[0]
    best = search.top(search.bm25(index, requests), 10, ["qid"])
    least = best.groupBy("qid").agg(F.min("score").alias("least"))
    cuts = search.bounded_levels(asked, blocks, least)
    for qid in (0, 1):
        of = cuts.filter((F.col("qid") == qid) & F.col("low").isNotNull())
        read = index.blocks.join(of, ["gram", "field"]).filter("level >= low").agg(F.sum("n")).first()[0]
        there = sum(whole[r["gram"], r["field"]] for r in asked.filter(F.col("qid") == qid).select("gram", "field").collect())
        assert there >= 4000 and read < there / 10, (qid, read, there)
    assert first < 4000 / 10
    assert "GreaterThanOrEqual(level" in index.from_level(levels)._jdf.queryExecution().toString()
    assert key(search.bounded_bm25(index, requests)) == key(best)


def test_empty_tables(spark, made, tmp_path):
    docs, fields, requests, index = made
    nothing = impacts.ImpactIndex.open(docs.limit(0), fields, str(tmp_path / "i"))
    assert search.bounded_bm25(nothing, requests).count() == 0
    assert search.bounded_bm25(index, requests.limit(0)).count() == 0
    assert impacts.ImpactIndex.open(docs, fields, str(tmp_path / "i")).texts.count() == 0
