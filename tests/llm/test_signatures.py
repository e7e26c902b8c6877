"""SimHash groups, the Merkle manifest and token alignment against plain versions."""

import bisect
import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import alignment, entry, merkle, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(200)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def edge_rows():
    """Nulls, empty and odd texts, ties, repeated rows, two long texts, near copies."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(60)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 60, 4)]
    texts = [None, "", " \t\n", "one", "One TWO", "a b c", "A  B\tc", " ".join(base), " ".join(base), "é▁ ü 日本語 <s> <|endoftext|> <0x41>", "\x1c \x85x   y", "double  space", "y" * 3000, " ".join(rng.choice(WORDS) for _ in range(30_000)), *near]
    rows = [(i, t, [None, "", "en", "de", "ä"][i % 5], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, "a b c", "en", None, None), (None, None, None, None, None), (5, "other", "en", "s", 5)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits):
    """The least index that each value's links lead to."""
    lead = list(range(len(values)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    return [top(i) for i in range(len(values))]


def test_simhash_is_spark_xxhash64(spark):
    row = spark.createDataFrame([("some words",), ("a" * 100 + "é",)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(r["t"].encode(), 42) for r in row)


def check_simhash(rows, out):
    keys = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    prints = [plain_fingerprint(t) for _, _, t in keys]
    lead = plain_components(prints, simhash.BITS)
    least = {}
    for (null, key, _), c in zip(keys, lead, strict=True):
        if not null:
            least[c] = min(least.get(c, key), key)
    want = {(None if k[0] else k[1], f"{p:016x}", least.get(c)) for k, p, c in zip(keys, prints, lead, strict=True)}
    assert {tuple(r) for r in out} == want
    assert len(out) == len(rows)


def test_simhash_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "part": F.lit("x"), "component_id": F.lit(0)})
    check_simhash(rows, simhash.near_duplicates(df).collect())
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    check_simhash(rows, entry.op11_simhash_dedup(spark, SF).collect())


@pytest.mark.parametrize("limit", [3, 9, 4096])
def test_links_of_crowded_buckets(spark, limit):
    """A ball of fingerprints around one, and strangers; small limits cut buckets twice more."""
    rng = random.Random(limit)
    centre = rng.getrandbits(64)
    values = {centre, 0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(40))}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 7)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    found = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(df, limit).collect()]
    assert found and all((u ^ v).bit_count() <= simhash.BITS for u, v in found)
    at, lead = {x: i for i, x in enumerate(values)}, list(range(len(values)))
    for _ in values:
        for u, v in found:
            lead[at[u]] = lead[at[v]] = min(lead[at[u]], lead[at[v]])
    assert lead == plain_components(values, simhash.BITS)


def plain_manifest(rows, changed, fanout=8):
    """Leaf, subroot, root, proof and folded root of each row, by plain loops."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(t))

    def tree(digests):
        proofs, nodes, where = [[] for _ in digests], list(digests), list(range(len(digests)))
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for i, w in enumerate(where):
                run, place = runs[w // fanout], w % fanout
                proofs[i].append((run[:place], run[place + 1 :]))
            where = [w // fanout for w in where]
            nodes = [sha(*r) for r in runs]
        return nodes[0] if nodes else None, proofs

    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((order(r[0]), leaf(r, r[1]), r))
    langs, trees = sorted(groups, key=order), {}
    for g in langs:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = tree([x[1] for x in groups[g]])
    root, upper = tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper, strict=True):
        for (_, own, r), proof in zip(groups[g], trees[g][1], strict=True):
            steps = proof + up
            back = leaf(r, changed(r))
            for left, right in steps:
                back = sha(*left, back, *right)
            out.append((r[0], own, trees[g][0], root, sha(*(d for s in steps for side in s for d in side)), back, back == root))
    return out


def lowered(r):
    if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 3:
        return r[1]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])


def key(rows):
    return sorted(rows, key=repr)


def manifest(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", entry._UPPER, entry._LOWER)).otherwise(F.col("text"))
    out = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": text})
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()]


def test_manifest_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"g": F.lit(1), "idx": F.lit("x"), "digest": F.lit(0), "path": F.lit(0)})
    assert key(manifest(df)) == key(plain_manifest(rows, lowered))
    assert manifest(df.limit(0)) == []
    one = [(4, "Text", "en", "s", 4)]
    assert manifest(spark.createDataFrame(one, DOCS)) == plain_manifest(one, lowered)


def test_manifest_of_many_groups_and_equal_rows(spark):
    """More groups than the fan-out, groups of one, 8, 9 and 65 rows, and a row that recurs."""
    sizes = [1, 8, 9, 65, *[2] * 8]
    rows = [(i * 1000 + j, f"Text {j}", f"l{i}", None, j) for i, n in enumerate(sizes) for j in range(n)]
    rows += [rows[5]] * 70
    assert key(manifest(spark.createDataFrame(rows, DOCS).repartition(5))) == key(plain_manifest(rows, lowered))


def test_manifest_given_documents(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert key([tuple(r) for r in entry.op12_merkle_manifest(spark, SF).collect()]) == key(plain_manifest(rows, lowered))


def plain_alignment(texts):
    """Whole texts through both libraries, tokens paired by a double loop over the bytes they cover."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECE_BPE}")
    letters = alignment._byte_letters()
    rows = []
    for text in texts:
        none = ([], [], [], [])
        if not text:
            rows.append(none)
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], []
        for i in ids[1]:
            p = b.id_to_piece(i)
            pieces[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            rows.append(none)
            continue
        spans = []
        for p in pieces:
            at, own = 0, []
            for x in p:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        held = [([], []) for _ in common]
        for k in (0, 1):
            for i, (_, t) in zip(ids[k], spans[k], strict=True):
                held[bisect.bisect_left(common, t)][k].append(str(i))
        groups = ["|".join(",".join(x) for x in g) for g in held]
        links, j = [], 0
        for i, (s, t) in zip(ids[0], spans[0], strict=True):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < t:
                if spans[1][j][1] > s:
                    links.append((i, ids[1][j]))
                j += 1
        rows.append((*ids, groups, links))
    docs = {}
    for *_, links in rows:
        for p in set(links):
            docs[p] = docs.get(p, 0) + 1
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return [(len(r[0]), len(r[1]), len(r[2]), len(r[3]), sum(docs[p] == best[p[0]] for p in r[3]), sum(docs[p] for p in r[3]), sha(";".join(r[2])) if r[2] else "") for r in rows]


def aligned(out):
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest).collect()]


@pytest.mark.parametrize("hot", [0, 300, alignment.HOT_PAIRS])
def test_alignment_edges(spark, hot):
    rows = edge_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"a": F.lit(1), "links": F.lit("x"), "row": F.lit(0), "n_a": F.lit(0)})
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)]
    assert key(aligned(alignment.align(df, hot=hot))) == key(want)
    assert alignment.align(df.limit(0), hot=hot).count() == 0


def test_alignment_of_pieces_and_forgotten_words(spark, monkeypatch):
    """Texts cut into pieces and a memory that is emptied give the tokens of the whole text."""
    monkeypatch.setattr(alignment, "PIECE", 50)
    monkeypatch.setattr(alignment, "KEPT", 200)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "12", "don't", "日", "x y", ". "]) for _ in range(400)) for _ in range(6)]
    known = alignment.Tokens(alignment.TOKENIZERS)
    got = []
    for t in texts:
        parts = [known.encode([alignment.CUT.split(x)])[0] for x in alignment._pieces(t)]
        got.append([x.tolist() for x in alignment._joined(parts)])
    for t, (a, a_ends, b, b_ends) in zip(texts, got, strict=True):
        assert a == known.a.encode(" " + t, add_special_tokens=False).ids and b == known.b.encode(t)
        assert a_ends[-1] == b_ends[-1] == len((" " + t).encode())


def test_new_words_are_encoded_in_runs(monkeypatch):
    """Words that are new come to the first tokenizer in few texts, and have the tokens that each has alone; those with white space at an end go alone."""
    monkeypatch.setattr(alignment, "RUN", 7)
    known, calls = alignment.Tokens(alignment.TOKENIZERS), []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    whole, known.a = known.a, Counting()
    words = [*(f"w{i}x\u00e9{i * 7919}" for i in range(60)), " lead", "", "tail\n", "a  b", "\u65e5\u672c", "<|endoftext|>", "</s>", "don't", "x\ty"]
    known.learn(words)
    side = known.sides[0]
    for i, w in enumerate(words):
        assert side.ids[side.starts[i] : side.starts[i + 1]].tolist() == whole.encode(" " + w, add_special_tokens=False).ids
    assert len(calls) <= len(words) // 7 + 5


def test_sets_of_ends_are_not_interpreted(spark):
    """Intersections, exceptions and names of tokens stand in a projection without lambdas."""
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = alignment.aligned(alignment.tokenised(df, "doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    with_lambdas = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert with_lambdas and not any("array_intersect" in x or "array_except" in x or "array<string>" in x for x in with_lambdas)


def test_alignment_given_documents(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = [(r["doc_id"], *x) for r, x in zip(rows, plain_alignment([r["text"] for r in rows]), strict=True)]
    assert key([tuple(r) for r in entry.op13_token_alignment(spark, SF).collect()]) == key(want)
