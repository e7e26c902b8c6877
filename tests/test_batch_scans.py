"""What a batch of requests costs in scans: no postings, letters instead of words, and pairs of sets by their frequent and their other words."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import postings, scan, search
from mnemospark.plans import catalog
from mnemospark.runtime import listed, shared_dir

DATA = "/root/testdata/sf0.001"


def key(df, *names):
    return sorted(tuple(r[n] if n != "score" else round(r[n], 8) for n in names) for r in df.collect())


@pytest.mark.parametrize(("table", "places"), [(1 << 24, 1 << 16), (0, 1 << 16), (1 << 24, 5)])
def test_grams_are_counted_by_letters(monkeypatch, table, places):
    """By a table or in order, texts together or one by one; grams that overlap themselves, letters that no gram has, and texts of nothing."""
    monkeypatch.setattr(postings.GramCounter, "TABLE", table)
    monkeypatch.setattr(postings.GramCounter, "PLACES", places)
    rng = random.Random(8)
    for letters in ("ab", "abc ", "aé漢\0"):
        grams = sorted({"".join(rng.choices(letters, k=rng.choice((2, 3, 4)))) for _ in range(25)})
        texts = ["".join(rng.choices(letters + "x\n", k=rng.choice((0, 1, 2, 60)))) for _ in range(40)]
        assert postings.GramCounter(grams).counts(texts).tolist() == [[t.count(g) for g in grams] for t in texts]
    assert postings.GramCounter([]).counts(["ab"]).shape == (1, 0) and postings.GramCounter(["ab"]).counts([]).shape == (0, 1)


def test_a_counter_keeps_no_words():
    """What a worker holds doesn't grow with the words that it has seen."""
    counter = postings.GramCounter(["ab", "abc", "zz"])
    held = lambda: {k: len(v) for k, v in vars(counter).items() if hasattr(v, "__len__")}
    before = held()
    counter.counts([f"w{i}ab x{i}" for i in range(5000)])
    assert held() == before


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_items_make_no_index(spark):
    folder = f"{shared_dir(spark)}/mnemospark"
    before = set(listed(spark, folder))
    assert catalog.queries()["bm25_bounded"](spark, DATA).count() == 20
    made = set(listed(spark, folder)) - before
    assert made and not [x for x in made if x.startswith("index-")]


def test_equal_texts_are_counted_once_and_found_each(spark):
    rows = [(f"d{i:03d}", None if i % 9 == 0 else "" if i % 10 == 0 else f"stone river{'s' * (i % 3)}", ["note"] if i % 2 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "id string, content string, tags array<string>").coalesce(2)
    requests = spark.createDataFrame([(1, "rivers stone note stone"), (2, "note")], "qid long, words string")
    fields = {"content": F.col("content"), "tags": F.array_join("tags", " ")}
    want = search.top(search.bm25(postings.TextIndex.of(docs, fields), requests), 7, ["qid"])
    assert key(search.text_search(docs, requests, 7, fields), "qid", "id", "score", "rank") == key(want, "qid", "id", "score", "rank")


SETS = "id string, t array<string>"


def best_by_hand(rows, asked, k):
    out = []
    for a, u in asked:
        found = []
        for i, t in rows:
            if i is not None and i != a:
                both = len(set(t or []) & set(u or []))
                found.append((-(both / max(1, len(set(t or [])) + len(set(u or [])) - both)), i))
        out += [(a, i, round(-s, 8), r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("per_pass", "bits"), [(4096, 64), (1, 64), (1, 0), (4096, 2)])
def test_sets_in_passes_are_exact(spark, monkeypatch, per_pass, bits):
    """Ties, copies, sets of nothing, sets that no other is like (the smallest ids come), ids of several rows, rows without an id, very large sets."""
    monkeypatch.setattr(scan, "PASS", per_pass)
    monkeypatch.setattr(scan, "BITS", bits)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"d{i:03d}", sorted(set(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randrange(0, 9))))) for i in range(130)]
    rows += [("alone", ["alone"]), ("null", None), (None, ["w0", "w1"]), ("twice", ["w1", "w2"]), ("twice", ["w1", "w2"]), ("large", [f"x{i}" for i in range(400)]), ("larger", [f"x{i}" for i in range(390)]), ("d000a", ["x1"]), ("0first", []), ("0first", [])]
    t = spark.createDataFrame(rows, SETS)
    asked = [r for r in rows if r[0] in ("alone", "null", "large", "d000a", "0first") or (r[0] or "")[-1:] == "7"]
    asked = [r for i, r in enumerate(asked) if r not in asked[:i]]
    got = search.top(scan.jaccard_best(t, spark.createDataFrame(asked, "a string, u array<string>"), 4), 4, ["a"])
    assert key(got, "a", "id", "score", "rank") == best_by_hand(rows, asked, 4)
    assert scan.jaccard_best(t, spark.createDataFrame([], "a string, u array<string>"), 4).count() == 0
    assert scan.jaccard_best(t.limit(0), spark.createDataFrame(asked, "a string, u array<string>"), 4).count() == 0


def test_few_rows_are_looked_at(spark):
    """Of rows that are all alike a request, only those better than its k-th so far pass."""
    import numpy as np

    best, passed = scan.Alike(np.full(16, 10), 3), 0
    rng = np.random.default_rng(5)
    for row in range(0, 4000, scan.ROWS):
        best.common[:] = rng.integers(1, 9, best.common.shape)
        before = best.held
        best.add(row, [10] * scan.ROWS)
        passed += max(0, best.held - before)
        best.cut()
    q, row, c, u = best.cut()
    assert (c == 8).all() and len(q) <= 16 * 6 and passed < 16 * 4000 / 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_previews_are_read_once(spark, monkeypatch):
    """Sets of all rows are written once, however many passes meet them, and texts go through no join."""
    monkeypatch.setattr(scan, "PASS", 1)
    folder, seen = f"{shared_dir(spark)}/mnemospark", []
    monkeypatch.setattr(catalog, "materialise", lambda df, name, made=catalog.materialise: seen.append(df) or made(df, name))
    before = set(listed(spark, folder))
    assert catalog.queries()["jaccard_topk"](spark, DATA).count() == 50
    (sets,) = [x for x in set(listed(spark, folder)) - before if x.startswith("sets-")]
    assert spark.read.parquet(f"{folder}/{sets}").count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
