"""Alignment of two tokenizers' tokens: groups between common ends, and links between tokens that overlap.

Python only tokenises: of a text it gives both sequences of ids and of the byte offsets where tokens end.  All that
follows is built of Spark's higher-order functions and aggregations:

1.  ``array_intersect`` of the two arrays of ends gives the ends of groups.
2.  The tokenizer also says which token covers a byte, so a common end finds its tokens without a search, and a group's
    tokens are a slice.
3.  Every end of either sequence closes one stretch of bytes that one token of each side covers, and no pair of tokens
    has two such stretches: the ends of the first side and those that the second alone has (``array_except``) list the links.
4.  An id pair's count is an aggregation over distinct pairs of documents.  Pairs of many documents are broadcast, ``HOT_PAIRS``
    of them at most; the others, each of few documents, meet their links by a join that has no hot keys.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast, 16 bytes each and as much again for the table.
HOT_PAIRS = 1 << 20
#: Characters of a text that are cut into words at once, and those of words whose tokens a worker keeps.
PIECE, KEPT = 1 << 18, 1 << 22
#: New words that the first tokenizer gets as one text.
RUN = 4096
#: Ids of the second tokenizer are below this.
SHIFT = 1 << 20

#: No token of either tokenizer reaches over a single space between two other characters, so the parts are tokenised apart.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that ``\\s`` takes, and their neighbourhoods of a space: a text with none of these is cut at every space.
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_IRREGULAR = [*(w + " " for w in _WHITE), *(" " + w for w in _WHITE)]


def words_of(text: str) -> list[str]:
    """The parts of a text between the spaces that ``CUT`` finds."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _IRREGULAR):
        return CUT.split(text)
    return text.split(" ")


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class _Side:
    """Tokens of known words, one after the other, in arrays that grow."""

    def __init__(self, names: list[bytes]):
        self.names, self.widths = names, np.array([len(x) for x in names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.starts, self.words, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, coded: list[list[int]], wholes: list[bytes]) -> np.ndarray:
        """Keeps the tokens of some words; which of them give their bytes back."""
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int64, int(n.sum()))
        self.ids, self.starts = _room(self.ids, self.size + len(flat)), _room(self.starts, self.words + len(n) + 1)
        self.ids[self.size : self.size + len(flat)] = flat
        self.starts[self.words + 1 : self.words + len(n) + 1] = self.size + np.cumsum(n)
        self.size, self.words = self.size + len(flat), self.words + len(n)
        own = np.add.reduceat(np.append(self.widths[flat], 0), np.concatenate(([0], np.cumsum(n)[:-1]))) * (n > 0)
        good = own == np.fromiter(map(len, wholes), np.int64, len(wholes))
        if good.all() and b"".join(map(self.names.__getitem__, flat.tolist())) == b"".join(wholes):
            return good
        return np.array([b"".join(self.names[i] for i in ids) == w for ids, w in zip(coded, wholes, strict=True)], bool)


def _room(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate((x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)))


class Tokens:
    """Both tokenizers with a memory of words; ``folder`` has their files."""

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        letters = _byte_letters()
        names = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("\u2581", " ").encode()
        self.sides = _Side([names.get(i, b"") for i in range(self.a.get_vocab_size())]), _Side([piece(i) for i in range(self.b.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.good = np.zeros(1 << 14, bool)
        self.kept = 0
        for side in self.sides:
            side.forget()

    def first(self, words: list[str], wholes: list[bytes]) -> list[list[int]]:
        """The first tokenizer's ids of each word.  Words go over in runs, as a call for each takes longer than its tokens, and part where their bytes end."""
        coded: list[list[int] | None] = [None] * len(words)
        joined = [i for i, w in enumerate(words) if w and not (w[0].isspace() or w[-1].isspace())]
        for at in range(0, len(joined), RUN):
            own = joined[at : at + RUN]
            ids = self.a.encode_batch_fast([" " + " ".join(words[i] for i in own)], add_special_tokens=False)[0].ids
            ends, to = np.cumsum(self.sides[0].widths[ids]), np.cumsum([len(wholes[i]) for i in own])
            last = np.searchsorted(ends, to)
            if last[-1] == len(ends) - 1 and (ends[last] == to).all():
                bounds = (last + 1).tolist()
                for i, p, q in zip(own, [0, *bounds[:-1]], bounds, strict=True):
                    coded[i] = ids[p:q]
        alone = [i for i, x in enumerate(coded) if x is None]
        for i, x in zip(alone, self.a.encode_batch_fast([" " + words[i] for i in alone], add_special_tokens=False), strict=True):
            coded[i] = x.ids
        return coded

    def learn(self, words: list[str]) -> None:
        at, wholes = len(self.places), [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        good = [side.add(coded, wholes) for side, coded in zip(self.sides, (self.first(words, wholes), self.b.encode(words, num_threads=1)), strict=True)]
        self.good = _room(self.good, at + len(words))
        self.good[at : at + len(words)] = good[0] & good[1]
        self.places.update(zip(words, range(at, at + len(words)), strict=True))
        self.kept += sum(map(len, words))

    def encode(self, parts: list[list[str]]) -> list[list[np.ndarray] | None]:
        """Of each list of words: ids and ends of the first tokenizer, and of the second; nothing where a word's bytes don't come back."""
        if self.kept > KEPT:
            self.forget()
        words = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        if (at < 0).any():
            self.learn(list(dict.fromkeys(words[i] for i in np.flatnonzero(at < 0).tolist())))
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        good = np.concatenate(([0], np.cumsum(~self.good[at])))
        sides = []
        for side in self.sides:
            n = side.starts[at + 1] - side.starts[at]
            first = np.concatenate(([0], np.cumsum(n)))
            ids = side.ids[np.repeat(side.starts[at] - first[:-1], n) + np.arange(first[-1])]
            sides.append((ids, np.cumsum(side.widths[ids]), first[bounds].tolist()))
        out: list[list[np.ndarray] | None] = []
        for i in range(len(parts)):
            row = []
            for ids, ends, at_ in sides:
                a, b = at_[i], at_[i + 1]
                row += [ids[a:b], ends[a:b] - (ends[a - 1] if a else 0)]
            out.append(row if good[bounds[i]] == good[bounds[i + 1]] else None)
        return out


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, without the spaces at which it is cut."""
    at = 0
    while len(text) - at > 2 * PIECE and (cut := CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _covers(ends: np.ndarray) -> np.ndarray:
    """Before each byte, and after the last, the place of the token over the byte before; of what stands before the first byte -1."""
    return np.repeat(np.arange(-1, len(ends), dtype=np.int32), np.concatenate(([1], np.diff(ends, prepend=0))).astype(np.int64))


def _joined(parts: list[list[np.ndarray] | None]) -> list[np.ndarray]:
    """Ids and ends of a text's pieces together; empty if one of them has none."""
    if not parts or any(p is None for p in parts):
        return [np.zeros(0, np.int64)] * 4
    if len(parts) == 1:
        return parts[0]
    shifts = np.concatenate(([0], np.cumsum([p[1][-1] for p in parts])[:-1]))
    return [np.concatenate([p[k] + (s if k % 2 else 0) for p, s in zip(parts, shifts, strict=True)]) for k in range(4)]


#: Bytes of text in a batch that goes back.
BATCH_BYTES = 1 << 18
_LOADED: dict[str, Tokens] = {}


def tokenised(documents: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``id, a, a_ends, b, b_ends, at_a, at_b``: ids of both tokenizers, the bytes of space+text at which their tokens end, and the place of the token that covers the byte before each of them."""

    def coded(known: Tokens, texts: list[str]) -> list[pa.Array]:
        found: list[list[list[np.ndarray] | None]] = [[] for _ in texts]
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= 2 * PIECE]
        for i, got in zip(short, known.encode([words_of(texts[i]) for i in short]), strict=True):
            found[i] = [got]
        for i, text in enumerate(texts):
            if len(text) > 2 * PIECE:
                found[i] = [known.encode([words_of(x)])[0] for x in _pieces(text)]
        rows = [_joined(f) for f in found]
        return [*(_lists([r[k] for r in rows], (pa.int64(), pa.int32())[k % 2]) for k in range(4)), *(_lists([_covers(r[k]) for r in rows], pa.int32()) for k in (1, 3))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizers not in _LOADED:
            _LOADED[tokenizers] = Tokens(tokenizers)
        known = _LOADED[tokenizers]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                to = max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
                yield pa.RecordBatch.from_arrays([ids.slice(first, to - first), *coded(known, texts.slice(first, to - first).to_pylist())], names=["id", "a", "a_ends", "b", "b_ends", "at_a", "at_b"])
                first = to

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, a array<long>, a_ends array<int>, b array<long>, b_ends array<int>, at_a array<int>, at_b array<int>")


def _group(start: Column, end: Column) -> Column:
    """The tokens of either side between two common ends, comma-joined."""

    def own(names: str, covers: str) -> Column:
        before, last = F.get(covers, start), F.get(covers, end)
        return F.when(last - before == 1, F.get(names, last)).otherwise(F.array_join(F.slice(names, before + 2, last - before), ","))

    return F.concat(own("a_names", "at_a"), F.lit("|"), own("b_names", "at_b"))


def aligned(tokens: DataFrame) -> DataFrame:
    """``id, n_a, n_b, n_groups, groups, links, n_links``: groups as ``a1,a2|b1;a3|b2,b3``; a link is its first id times ``SHIFT`` plus its second.

    Sets and names are made in a projection of their own, as what stands in a call with a lambda is interpreted.
    """
    sets = tokens.select(
        "*", F.array_intersect("a_ends", "b_ends").alias("common"), F.array_except("b_ends", "a_ends").alias("b_only"),
        F.col("a").cast("array<string>").alias("a_names"), F.col("b").cast("array<string>").alias("b_names"),
    )
    n = F.size("common")
    starts = F.concat(F.slice(F.array(F.lit(0)), 1, F.least(n, F.lit(1))), F.slice("common", 1, F.greatest(n - 1, F.lit(0))))
    over = lambda ids, covers, e: F.get(ids, F.get(covers, e))
    links = F.concat(
        F.zip_with("a", "a_ends", lambda i, e: i * SHIFT + over("b", "at_b", e)), F.transform("b_only", lambda e: over("a", "at_a", e) * SHIFT + over("b", "at_b", e))
    )
    return sets.select(
        "id", F.size("a_names").cast("long").alias("n_a"), F.size("b_names").cast("long").alias("n_b"), n.cast("long").alias("n_groups"),
        F.array_join(F.zip_with(starts, "common", _group), ";").alias("groups"), links.alias("links"), (F.size("a") + F.size("b_only")).cast("long").alias("n_links"),
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """``link, docs, best``: how many rows hold an id pair linked, and whether no pair of its first id is held by more.

    Rows are counted in each task before the shuffle; a window holds the pairs of one id of the first vocabulary.
    """
    counts = rows.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("docs"))
    first = Window.partitionBy(F.floor(F.col("link") / SHIFT))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(first))


def counted(rows: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum``: sums over the links of each row that has some.

    The pairs of most rows are broadcast, ``hot`` of them at most, by powers of two of their counts; the others meet their
    links by a shuffled join, in which none of them is a hot key.
    """
    level = F.floor(F.log2("docs")).cast("int")
    levels = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    floor, room = 64, hot
    for at in sorted(levels, reverse=True):
        room -= levels[at]
        if room < 0:
            break
        floor = at
    links = rows.select("row", F.explode("links").alias("link"))
    common = F.broadcast(counts.filter(level >= floor))
    sums = links.join(common, "link").groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("docs").alias("count_sum"))
    if all(at >= floor for at in levels):
        return sums
    rare = links.join(common, "link", "left_anti").groupBy("row", "link").agg(F.count(F.lit(1)).alias("n")).join(counts.filter(level < floor), "link")
    rare = rare.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("docs") * F.col("n")).alias("count_sum"))
    return sums.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, hot: int = HOT_PAIRS, shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """``id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum`` of every row; ``groups`` is what ``shown`` makes of the text that ``aligned`` writes.

    Null and empty texts, and those of which a tokenizer doesn't give the bytes back, have no tokens: zeros and an empty
    ``groups``.  Rows count each for itself, whatever their ids (null ones too); ties for the most rows are all best.  Other
    columns aren't read, and an empty table gives no rows.
    """
    rows = aligned(tokenised(documents, id_col, text_col, tokenizers))
    rows = materialise(rows.withColumns({"groups": shown(F.col("groups")), "row": F.monotonically_increasing_id()}), "aligned")
    counts = materialise(pair_counts(rows), "pair-counts")
    sums = counted(rows, counts, hot)
    out = rows.select("row", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "groups", "n_links").join(sums, "row", "left")
    return out.withColumns({"n_best": F.coalesce("n_best", F.lit(0)), "count_sum": F.coalesce("count_sum", F.lit(0))}).drop("row")
