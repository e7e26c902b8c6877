"""Near duplicates, chunks and decontamination against brute force."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemospark.llm import chunk_dedup, decontam, entry, minhash, textkit

from .conftest import sample_rows


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def _set(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    at = {i: i for i, _ in rows if i is not None}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    sets = [(i, _set(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                u, v = sorted((find(i), find(j)))
                at[v] = u
    return {i: find(i) for i in at}


def test_near_duplicates(spark, docs):
    rows = sample_rows()
    want = _components([(i, t) for i, t, *_ in rows])
    got = minhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(len(_set(t)))
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["n_shingles"] in texts[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_noisy_family(spark, docs):
    """Many edited copies of one text, most pairs of which are not linked directly."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):
        text = [f"e{i}_{k}" if rng.random() < (i % 7) / 60 else w for k, w in enumerate(base)]
        rows.append((i * 3 + 1, " ".join(text), "en", "src0"))
    want = _components([(i, t) for i, t, *_ in rows])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_ids_with_several_texts(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (9, a, "en", "s"), (3, b, "en", "s"), (7, "other words stand here today", "en", "s")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {(5, 3), (9, 3), (3, 3), (7, 7)}


def test_empty_tables(spark, docs):
    assert minhash.near_duplicates(docs([])).collect() == []
    assert chunk_dedup.repeated_spans(docs([])).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs([]), items).collect() == []
    got = decontam.find_contamination(docs([(1, "a b", "en", "s")]), items).collect()
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (2, 0, [])


def test_drop_near_duplicates(spark, docs):
    rows = sample_rows()
    df = docs(rows)
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert got == sorted(set(_components([(i, t) for i, t, *_ in rows]).values()))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (70, 2))] + [(100 + i, 101 + i) for i in range(20)]
    at = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in at.items() if any(x in e and e[0] != e[1] for e in edges)}


def _hits(text, items, window):
    rx = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    doc = re.findall(rx, (text or "").encode().lower())
    hit, own = set(), set()
    for k, t in items:
        w = re.findall(rx, (t or "").encode().lower())
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(doc) - n + 1 if grams else 0):
            if tuple(doc[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                own.add(str(k))
    return len(doc), len(hit), sorted(own)


def test_decontamination(spark, docs):
    rows = sample_rows()
    items = [(1, rows[3][1] + " x"), (2, "One TWO three four five six seven eight nine ten!"), (3, None), (4, ""), (5, "w5 w6"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (6, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(docs(rows), bench).collect()
    assert len(got) == len(rows)
    want = sorted(str((i, *_hits(t, items, 10))) for i, t, *_ in rows)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == want
    # Many automata find what one finds.
    again = decontam.find_contamination(docs(rows), bench, most=9).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_automaton_of_many_items():
    """Windows, items and lengths against sets of word sequences; arrays hold each state once."""
    rng = np.random.default_rng(6)
    for size in (1, 2, 3, 30):
        items = [(str(k), [b"w%d" % x for x in rng.integers(0, size, int(rng.integers(1, 40)))]) for k in range(12)]
        a = decontam.SuffixAutomaton(items, 4)
        assert len(a.word) <= 2 * sum(len(w) for _, w in items) + 1
        for _ in range(20):
            seq = [b"w%d" % x for x in rng.integers(0, size + 1, int(rng.integers(1, 60)))]
            if rng.random() < 0.5:
                k = int(rng.integers(0, 12))
                seq[3:3] = items[k][1][1:9]
            ranges, found = a.scan(seq)
            hit, own = set(), set()
            for k, (_, w) in enumerate(items):
                n = min(4, len(w))
                grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                for i in range(len(seq) - n + 1):
                    if tuple(seq[i : i + n]) in grams:
                        hit |= set(range(i, i + n))
                        own.add(k)
            assert {i for x, y in ranges for i in range(x, y)} == hit and found == own


def test_remove_contamination(spark, docs):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, "other words that are of no text here but of the test")], "item_id long, text string")
    long = "w1 " * 200000
    rows = [(1, f"Before it stood this: {item.title()}, and after it so many more words that it stays.", "en", "s"), (2, item, "en", "s"), (3, None, "en", "s"), (4, "clean é", "en", "s"), (5, "", "en", "s")]
    rows += [(6, long + item + " é", "en", "s"), rows[0], (None, rows[0][1], "en", "s"), (1, "another text of this id", "en", "s")]
    cut = "Before it stood this:  , and after it so many more words that it stays."
    want = [(1, cut), (1, cut), (None, cut), (3, None), (4, "clean é"), (5, ""), (6, long + "  é"), (1, "another text of this id")]
    df = docs(rows).withColumnRenamed("rank", "spans").withColumnRenamed("h", "items")
    for most in (decontam.AUTOMATON_WORDS, 11):
        out = decontam.remove_contamination(df, bench, most=most)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    none = bench.limit(0)
    assert decontam.remove_contamination(df, none).count() == len(rows) and decontam.remove_contamination(df.limit(0), bench).collect() == []


def _passage(tag, n):
    return " ".join(f"{tag}{i * 7 % 97}" for i in range(n))


def test_repeated_passages(spark, docs):
    shared, rows = _passage("shared", 60), []
    for i in range(12):
        text = _passage(f"own{i}x", 80)
        cut = 20 * (i + 1)
        rows.append((i, text[:cut] + " " + shared + " " + text[cut:] if i in (2, 5, 9) else text, "en", "s"))
    rows += [(20, None, "en", "s"), (21, "", "en", "s"), (None, shared, "en", "s"), (22, "a b c", "en", "s"), (23, "a b c", "en", "s")]
    spans = chunk_dedup.repeated_spans(docs(rows)).collect()
    assert {r["doc_id"] for r in spans} == {2, 5, 9}
    texts = {i: t for i, t, *_ in rows}
    for r in spans:
        assert texts[r["doc_id"]].encode()[r["start"] : r["stop"]].decode() in shared
        assert r["first_id"] == 2 and r["copies"] == 3 and r["n_words"] >= 40
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(docs(rows[:12])).collect()}
    assert out[2] == texts[2] and len(out[5]) < len(texts[5]) - 200 and all(out[i] == texts[i] for i in (0, 1, 3, 4))


def test_every_document_and_short_passages(spark, docs, tmp_path):
    """The query has a row for each document; passages of few words stand beside the others."""
    rng = np.random.default_rng(12)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    long, short = own(60), [(own(15), (2, 4, 5)) for _ in range(6)]
    rows = [(i, " ".join((own(50), *(x + " " + own(20) for x, ids in ((long, (1, 4)), *short) if i in ids), own(50))), "en", "s") for i in range(8)]
    rows += [(20, None, "en", "s"), (21, "", "en", "s")]
    docs(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in entry.op3_chunk_dedup(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    want = _plain_spans([r[:2] for r in rows], across=True, min_words=0)
    for i, r in got.items():
        of = [x for x in want if x[0] == i]
        big, small = [x for x in of if x[4] >= chunk_dedup.SPAN_WORDS], [x for x in of if x[4] < chunk_dedup.SPAN_WORDS]
        assert (r["n_spans"], r["repeated_words"], r["short_spans"], r["short_words"]) == (len(big), sum(x[4] for x in big), len(small), sum(x[4] for x in small))
        assert r["short_bytes"] == sum(x[3] - x[2] for x in small) and r["first_doc_id"] == min((x[5] for x in big), default=None)
    assert {i for i, r in got.items() if r["n_spans"]} == {1, 4} and got[2]["short_spans"] and got[5]["short_spans"]


def test_chunks_resist_shifts():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, 20000).astype(np.uint8)
    y = np.concatenate((x[:5000], rng.integers(97, 123, 33).astype(np.uint8), x[5000:]))
    a, b = (chunk_dedup.digests(t, chunk_dedup.cut(t)) for t in (x, y))
    assert len(np.setdiff1d(a, b)) <= 4
    for size in (0, 1, 11, 12, 5000):
        ends = chunk_dedup.cut(x[:size])
        assert (ends[-1] if size else 0) == size and (np.diff(np.concatenate(([0], ends))) <= chunk_dedup.MAX).all()


def _plain_cuts(raw):
    """Gear hashes byte by byte; a cut where one is small, else at the smallest when a chunk gets too long."""
    gear = [int(x) for x in chunk_dedup._GEAR]
    h = [sum(gear[raw[i - k]] << k for k in range(min(chunk_dedup.WINDOW, i + 1))) % (1 << 32) for i in range(len(raw))]
    ends, last, at = [], 0, 0
    while at <= len(raw):
        cut = at < len(raw) and h[at] < (1 << 32) // chunk_dedup.SPREAD
        if cut or at == len(raw):
            while (at + 1 if cut else at) - last > chunk_dedup.MAX:
                near = range(last + chunk_dedup.MIN - 1, last + chunk_dedup.MAX)
                last = min(near, key=lambda i: (h[i], i)) + 1
                ends.append(last)
            if cut and at + 1 - last >= chunk_dedup.MIN:
                ends.append(last := at + 1)
        at += 1
    return ends + [len(raw)] if len(raw) > last else ends


def _plain_spans(rows, later_only=False, across=False, min_words=chunk_dedup.SPAN_WORDS):
    units = []
    for i, t in rows:
        raw = (t or "").encode()
        if i is None or not raw:
            continue
        ends = _plain_cuts(raw)
        edges = list(zip([0, *ends[:-1]], ends, strict=True))
        for k in range(max(1, len(edges) - 1)):
            a, b = edges[k][0], edges[min(k + 1, len(edges) - 1)][1]
            units.append((i, t, k, tuple(raw[x:y] for x, y in edges[k : k + 2]), a, b))
    holders = {}
    for u in units:
        holders.setdefault(u[3], []).append(u[0])
    good = lambda u: (min(holders[u[3]]) < max(holders[u[3]]) if across else len(holders[u[3]]) > 1) and (not later_only or min(holders[u[3]]) < u[0])
    out, known = set(), sorted({u for u in units if good(u)}, key=lambda u: u[:3])
    runs = []
    for u in known:
        if runs and runs[-1][-1][:2] == u[:2] and runs[-1][-1][2] + 1 == u[2]:
            runs[-1].append(u)
        else:
            runs.append([u])
    for run in runs:
        raw, a, b = run[0][1].encode(), run[0][4], run[-1][5]
        n = len([m for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw) if a <= m.start() < b])
        while a and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        if n >= min_words:
            out.add((run[0][0], run[0][1], a, b, n, min(min(holders[u[3]]) for u in run), max(len(holders[u[3]]) for u in run)))
    return out


def test_cuts_against_plain_loop(monkeypatch):
    monkeypatch.setattr(textkit, "PIECE", 1000)
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 1, 13, 999, 1000, 1001, 5000)] + [np.frombuffer(("die " * 900 + "é" * 700).encode(), np.uint8), np.full(3000, 120, np.uint8)]
    for x in texts:
        assert chunk_dedup.cut(x).tolist() == _plain_cuts(x.tobytes())


def test_spans_against_plain_version(spark, docs):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeéßñ漢 "), int(rng.integers(2, 9))))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(25):
        parts = [" ".join(word() for _ in range(int(rng.integers(5, 60)))) for _ in range(3)]
        rows.append((i, " ".join((parts[0], shared[i % 3], parts[1], shared[(i + 1) % 3] if i % 4 else "", parts[2])), "en", "s"))
    # Repeated rows, an id with two texts, copies, a text beyond a piece, runs of one word, nulls.
    rows += [rows[3], rows[3], (4, "\uFFFD " + shared[0] + " \uFFFD", "en", "s"), (30, rows[7][1], "en", "s"), (31, "long " + " ".join(word() for _ in range(70000)) + shared[1], "en", "s")]
    rows += [(32, "die " * 300, "en", "s"), (None, shared[0], "en", "s"), (33, None, "en", "s"), (34, "", "en", "s")]
    df = docs(rows)
    for how in ({}, {"across": True}, {"later_only": True}, {"min_words": 1}):
        got = chunk_dedup.repeated_spans(df, **how).collect()
        want = _plain_spans([r[:2] for r in rows], **how)
        key = lambda r: (r["doc_id"], r["start"], r["stop"], r["n_words"], r["first_id"], r["copies"])
        assert {key(r) for r in got} == {(i, *rest) for i, _, *rest in want} and len(got) == len(want)
    cuts = {}
    for i, t, a, b, *_ in _plain_spans([r[:2] for r in rows], later_only=True):
        cuts.setdefault((i, t), []).append((a, b))
    out = chunk_dedup.deduplicate(df)
    assert out.columns == df.columns
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for a, b in sorted(cuts.get((i, t), []), reverse=True):
            raw = raw[:a] + raw[b:]
        want.append((str(i), None if t is None else raw.decode()))
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert any("\uFFFD" in (t or "") for _, t in want)
    assert chunk_dedup.deduplicate(docs([])).collect() == []


def test_runs_without_cut_points_align(spark, docs):
    """One phrase repeated has few windows and often no cut point; it is found at any offset."""
    rng = np.random.default_rng(5)
    word = lambda: bytes(rng.integers(97, 123, int(rng.integers(3, 9))).astype(np.uint8))
    rows, passages = [], 0
    while passages < 8:
        phrase = b" ".join(word() for _ in range(int(rng.integers(1, 4))))
        run = b" ".join([phrase] * (100 // len(phrase.split())))
        if (chunk_dedup.gear(np.frombuffer(run, np.uint8))[16:] < (1 << 32) // chunk_dedup.SPREAD).any():
            continue
        for k in range(2):
            own = [b" ".join(word() for _ in range(int(rng.integers(30, 90)))) for _ in range(2)]
            rows.append((passages * 2 + k, b" ".join((own[0], run, own[1])).decode(), "en", "s"))
        passages += 1
    spans = chunk_dedup.repeated_spans(docs(rows)).collect()
    assert {r["doc_id"] for r in spans} == {r[0] for r in rows}
    # What two texts share, not only what recurs in one of them.
    of = lambda i: chunk_dedup.digests(x := np.frombuffer(rows[i][1].encode(), np.uint8), chunk_dedup.cut(x))
    assert all(len(np.intersect1d(of(i), of(i + 1))) for i in range(0, len(rows), 2))


def test_words():
    texts = ["Hello, Wörld 12", "", "É a", " x\ny\x0bz ", None, "a" * 600000 + " b " + "word " * 100000]
    data, offsets = textkit.texts_of(pa.array(texts))
    for table, rx in ((textkit.SPACES, rb"[^\x20\x09-\x0D]+"), (textkit.NON_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for g in textkit.words_of(data, offsets, table):
            for i in range(g.first, g.last):
                a, b = g.bounds[i - g.first], g.bounds[i - g.first + 1]
                shift = offsets[i] - offsets[g.first]
                raw = (texts[i] or "").encode().lower()
                want = [m.span() for m in re.finditer(rx, raw)]
                assert [(s - shift, e - shift) for s, e in zip(g.starts[a:b], g.ends[a:b], strict=True)] == want
                for (s, e), h in zip(want, g.hashes[a:b].tolist(), strict=True):
                    assert seen.setdefault(raw[s:e], h) == h
        assert len(set(seen.values())) == len(seen)
