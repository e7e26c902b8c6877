"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all test items.  The words of each document are streamed
through it; the state tells the longest run of words, ending here, that occurs in some item.
Where that run is as long as a window, the window ending here occurs in an item, and its words are
marked.  Words outside the automaton's alphabet lead to the root from every state, so a document
is first cut into runs of known words, and runs shorter than the shortest window end there.

The set of items of a window is that of its state: the items whose words pass through the state or
one that has it as a suffix.  It is propagated along the suffix links once, when the automaton is built.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map, materialise

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of test items in one automaton.  More items are dealt over several automata, one pass of the documents each.
AUTOMATON_WORDS = 500_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of words, in flat arrays.

    Most states have one transition: its word and target stand in arrays.  Those of states with more are in small dictionaries.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.alphabet: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = []
        for _, ws in items:
            seq = array("i", [self.alphabet.setdefault(w, len(self.alphabet)) for w in ws])
            last = 0
            for c in seq:
                last = self._extend(last, c)
            coded.append(seq)
        self.shortest = min([window, *(len(s) for s in coded if s)])
        #: Short items: state -> (length, item) of items that are just its string of that length.
        self.short: dict[int, list[tuple[int, int]]] = {}
        #: Items by state, for states of a window or more; states with one item are the rule.
        one = array("i", [-1]) * len(self.word)
        several: dict[int, set[int]] = {}

        def own(v: int, ks) -> None:
            for k in ks:
                if one[v] in (-1, k) and v not in several:
                    one[v] = k
                else:
                    several.setdefault(v, {one[v]}).add(k)

        for k, seq in enumerate(coded):
            at = 0
            for c in seq:
                at = self._next(at, c)
                if self.length[at] >= window:
                    own(at, (k,))
            if seq and len(seq) < window:
                self.short.setdefault(at, []).append((len(seq), k))
        for v in np.argsort(-np.frombuffer(self.length, np.int32), kind="stable").tolist():
            up = self.link[v]
            if up > 0 and self.length[up] >= window:
                own(up, several.get(v) or ((one[v],) if one[v] >= 0 else ()))
        self.one, self.several = one, {v: tuple(x) for v, x in several.items()}
        #: Of each state, whether short items are suffixes of its strings.
        self.ends = bytearray(len(self.word))
        if self.short:
            for v in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
                self.ends[v] = v in self.short or self.ends[self.link[v]]

    def _next(self, v: int, c: int) -> int:
        """The target of a transition, -1 if there is none."""
        if self.word[v] == c:
            return self.to[v]
        more = self.more.get(v)
        return -1 if more is None else more.get(c, -1)

    def _set(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (-1, c):
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _state(self, word: int, to: int, link: int, length: int) -> int:
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.word) - 1

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self._next(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(-1, 0, 0, length[last] + 1)
        p = last
        while p != -1 and (q := self._next(p, c)) < 0:
            self._set(p, c, cur)
            p = link[p]
        if p != -1:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.word[q], self.to[q], self.link[q], self.length[p] + 1)
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p != -1 and self._next(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def owners(self, v: int) -> tuple[int, ...]:
        return self.several.get(v) or ((self.one[v],) if self.one[v] >= 0 else ())

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of word positions, and the items of the windows that occur."""
        word, to, more, link, length, window = self.word, self.to, self.more, self.link, self.length, self.window
        code, ends, none = self.alphabet.get, self.ends, {}
        state = matched = 0
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, w in enumerate(seq):
            c = code(w, -2)
            while True:
                nxt = to[state] if word[state] == c else more.get(state, none).get(c, -1)
                if nxt >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if nxt >= 0:
                state = nxt
                matched += 1
            else:
                matched = 0
            if matched >= window:
                v = state
                while length[link[v]] >= window:
                    v = link[v]
                # v holds the last `window` words: it or its strings' suffixes.
                items.update(self.owners(v))
                ranges.append((i + 1 - window, i + 1))
            if matched and ends[state]:
                # Short items that are suffixes of what is matched.
                v = state
                while v > 0 and ends[v]:
                    for n, k in self.short.get(v, ()):
                        if n <= matched:
                            items.add(k)
                            ranges.append((i + 1 - n, i + 1))
                    v = link[v]
        return ranges, items


def _covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _known_hashes(automaton: SuffixAutomaton) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    ws = list(automaton.alphabet)
    if ws:
        data, offsets = textkit.texts_of(pa.array([w.decode("utf-8", "replace") for w in ws]))
        parts += [x.hashes for x in textkit.words_of(data, offsets, textkit.NON_ALNUM)]
    return np.unique(np.concatenate(parts))


def scan_batch(texts: pa.Array, automaton: SuffixAutomaton, known: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], list[tuple[int, int]], set[int]]]:
    """For each text: index, number of words, hit ranges of words, the same as byte ranges, items."""
    data, offsets = textkit.texts_of(texts)
    need = automaton.shortest
    for g in textkit.words_of(data, offsets, textkit.NON_ALNUM):
        at = np.searchsorted(known, g.hashes)
        is_known = np.zeros(len(g.hashes) + 1, dtype=bool)
        if len(known):
            is_known[:-1] = known[np.minimum(at, len(known) - 1)] == g.hashes
        base = int(offsets[g.first])
        flags = is_known[:-1]
        for i in range(g.last - g.first):
            a, b = int(g.bounds[i]), int(g.bounds[i + 1])
            ranges: list[tuple[int, int]] = []
            items: set[int] = set()
            if b - a >= need and len(known):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[a:b].view(np.int8), [0]))))
                runs = edge.reshape(-1, 2)
                for s, e in runs[runs[:, 1] - runs[:, 0] >= need].tolist():
                    seq = [textkit.LOWER[data[base + x : base + y]].tobytes() for x, y in zip(g.starts[a + s : a + e].tolist(), g.ends[a + s : a + e].tolist(), strict=True)]
                    found, more = automaton.scan(seq)
                    ranges += [(s + x, s + y) for x, y in found]
                    items |= more
            ranges = _covered(ranges)
            start = int(offsets[g.first + i]) - base
            yield g.first + i, b - a, ranges, [(int(g.starts[a + x]) - start, int(g.ends[a + y - 1]) - start) for x, y in ranges], items


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", most: int = AUTOMATON_WORDS) -> DataFrame:
    """``id, n_words, n_hit, items (array<string>), spans (array<struct<start,end>>)`` per document.

    ``spans`` are byte ranges of the UTF-8 text that windows cover.  A null or empty text has no
    words and is clean; items without words match nothing; an item of fewer than ``window`` words
    is one window; items of equal id and text count once, null ids count as ``''``.  Repeated
    documents are judged each; other columns aren't read; empty tables give empty or clean results.

    An automaton is made of items of about ``most`` words (more only if one item has more).  A larger benchmark is dealt over several
    automata by hash: the documents are written with numbers, passed once for each automaton, and what the passes found meets by number.
    So neither the driver nor a worker holds more than one automaton.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]
    found = _found(source, items, window, most)
    return found.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_hit", "items", "spans")


_SPANS = "array<struct<start:long,end:long>>"
#: Words from and to, and the bytes of their span.
_RANGES = "array<struct<first:long,last:long,start:long,end:long>>"


def _dealt(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Distinct items ``k, text`` with the group of each, and how many groups there are."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("k"), F.col("text").cast("string").alias("text")).distinct()
    n = rows.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    groups = max(1, -(-int(n) // most))
    return rows.withColumn("group", F.pmod(F.xxhash64("k", "text"), F.lit(groups)).cast("int")), groups


def _automaton(items: DataFrame, group: int, window: int):
    rows = items.filter(F.col("group") == group).orderBy("k", "text").toLocalIterator()  # items of about AUTOMATON_WORDS words
    a = SuffixAutomaton([(r["k"], ws) for r in rows if (ws := words(r["text"]))], window)
    return items.sparkSession.sparkContext.broadcast((a, _known_hashes(a)))


def _found(source: DataFrame, items: DataFrame, window: int, most: int) -> DataFrame:
    """Rows (id, text, ...) -> ``id, n_words, n_hit, items, spans`` and the other columns but the text."""
    dealt, groups = _dealt(items, most)
    others = [c for c in source.columns if c not in ("id", "text")]
    kinds = dict(source.dtypes)
    schema = ", ".join([f"id {kinds['id']}", "n_words long", "n_hit long", "items array<string>", f"ranges {_RANGES}", *(f"{c} {kinds[c]}" for c in others)])
    scan = lambda rows, g: arrow_map(rows.select("id", "text", *others), _scanner(_automaton(dealt, g, window)), schema)
    if groups == 1:
        return scan(source, 0).withColumn("ranges", _bytes("ranges")).withColumnRenamed("ranges", "spans")
    rows = materialise(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    others.append("_row")
    schema += ", _row long"
    hits = None
    for g in range(groups):
        one = materialise(scan(rows, g).filter("n_hit > 0").select("_row", "items", "ranges"), "hits")
        hits = one if hits is None else hits.unionByName(one)
    # A row for each document and automaton that found something in it: an array each of bounded size, together.
    merged = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _union(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    size = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    words_of = F.coalesce(F.regexp_count(F.lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    none = lambda kind: F.array().cast(kind)
    out = rows.join(merged, "_row", "left").select(
        "id", words_of.alias("n_words"), F.coalesce(size, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none("array<string>")).alias("items"), F.coalesce(_bytes("ranges"), none(_SPANS)).alias("spans"), *others,
    )
    return out


def _bytes(ranges: str):
    return F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def _union(ranges):
    """Sorted ranges, those that touch or overlap as one."""

    def join(done, x):
        last = F.element_at(done, -1)
        longer = lambda k: F.greatest(last[k], x[k]).alias(k)
        both = F.struct(last["first"].alias("first"), longer("last"), last["start"].alias("start"), longer("end"))
        return F.when(last["last"] >= x["first"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(_RANGES), lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(join(done, x)))


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = shared.value
        for batch in batches:
            n = batch.num_rows
            n_words, size, items = [0] * n, [0] * n, [()] * n
            ranges: list[list[dict]] = [[]] * n
            for i, count, found, where, owners in scan_batch(batch.column(1), automaton, known):
                n_words[i], size[i], items[i] = count, sum(b - a for a, b in found), sorted({automaton.names[k] for k in owners})
                ranges[i] = [{"first": a, "last": b, "start": x, "end": y} for (a, b), (x, y) in zip(found, where, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words, pa.int64()), pa.array(size, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(ranges, pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))), *(batch.column(i) for i in range(2, batch.num_columns)),
                ],
                names=["id", "n_words", "n_hit", "items", "ranges", *batch.schema.names[2:]],
            )

    return scan


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", max_share: float = 0.5, most: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` with every span that windows of test items cover cut out of its text.

    Rows of which windows cover more than ``max_share`` of the words go whole; clean rows pass as
    they are (a null or empty text stays so).  What stood on both sides of a cut is parted by a blank.  Rows count for themselves, whatever their ids;
    names of other columns don't matter; without items or rows nothing changes.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    text = F.col(of[text_col])
    # Columns other than the text ride along, so that one pass is enough where one automaton is.
    source = docs.toDF(*names).select(F.lit(0).alias("id"), text.cast("string").alias("text"), *names)
    found = _found(source, items, window, most)
    raw, n = F.col(of[text_col]).cast("string").cast("binary"), F.size("spans")
    edge = lambda i, name: F.get(F.col("spans"), i)[name]
    begin = lambda i: F.coalesce(edge(i - 1, "end"), F.lit(0)).cast("int")
    end = lambda i: F.coalesce(edge(i, "start").cast("int"), F.octet_length(text.cast("string")))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(raw, begin(i) + 1, end(i) - begin(i)).cast("string"))
    cut = F.when(n > 0, F.array_join(pieces, " ").cast(dict(docs.dtypes)[text_col])).otherwise(text)
    kept = found.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words"))
    return kept.select(*(cut.alias(c) if c == text_col else F.col(x).alias(c) for c, x in of.items()))
