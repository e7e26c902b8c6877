"""The text index: postings of character n-grams, written once and searched by equi-joins.

Three tables: ``postings`` (gram, field, id, tf, len), a row for each gram of a text, sorted by gram within files; ``grams`` (gram, field, df); and
``sizes`` (field, n, avg_len).  A search meets the grams of its words with them; no text is read again.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import exists, mended, shared_dir, ship, spread

LOW, HIGH = 2, 4
#: Grams that are named in the scan of postings, which then skips pages without them.
NAMED = 256
#: Rows of a common gram are dealt over this many tasks where postings are written.
SALT = 16


def gram_counts(text: str) -> tuple[list[str], list[int]]:
    """Distinct 2- to 4-grams of a text, and how often each occurs without overlapping itself."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, code = np.unique(points, return_inverse=True)
    if len(letters) > 1 << 16:
        seen = Counter(text[i : i + n] for n in range(LOW, HIGH + 1) for i in range(len(text) - n + 1))
        return list(seen), [text.count(g) if _repeats(g) else c for g, c in seen.items()]
    code = code.astype(np.uint64)
    grams: list[str] = []
    counts: list[np.ndarray] = []
    for n in range(LOW, HIGH + 1):
        if len(code) < n:
            break
        key = np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            key |= code[k : len(code) - n + 1 + k] << np.uint64(16 * k)
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        at = first[:, None] + np.arange(n)
        shown = points[at]
        raw = shown.tobytes().decode("utf-32-le", "surrogatepass")
        own = [raw[i : i + n] for i in range(0, len(raw), n)]
        # A gram that can overlap itself occurs fewer times apart.
        twice = np.zeros(len(first), bool)
        for k in range(1, n):
            twice |= (shown[:, k:] == shown[:, : n - k]).all(axis=1)
        for i in np.flatnonzero(twice & (times > 1)).tolist():
            times[i] = text.count(own[i])
        grams += own
        counts.append(times)
    return grams, np.concatenate(counts).tolist() if counts else []


def _repeats(gram: str) -> bool:
    return any(gram[k:] == gram[: len(gram) - k] for k in range(1, len(gram)))


class GramCounter:
    """How often each of some grams occurs in texts, as ``gram_counts`` counts.

    The grams' beginnings are numbered by their length.  Of all places of some texts at once, the number of the beginning that stands there is
    looked up from that of the one shorter by a letter, so a text's cost is its length, whatever its words are.
    """

    #: Letters that are looked through at once, so that arrays stay in a core's cache; entries of a table of beginnings, of which more are searched in order.
    PLACES, TABLE = 1 << 16, 1 << 24

    def __init__(self, grams: list[str]):
        self.size = len(grams)
        self.grams = grams
        letters = sorted({c for g in grams for c in g})
        self.width = len(letters) + 1
        #: Each letter's number, 0 for those of no gram; one of these stands between texts.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.between = next(c for c in map(chr, range(0x110000)) if c not in set(letters))
        begun = {c: i for i, c in enumerate(letters, 1)}
        number = {g: i for i, g in enumerate(grams)}
        #: For each length: the beginnings' table, or their keys in order; the gram that each is, or -1; and whether it can overlap itself.
        self.steps: list[tuple[np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]] = []
        for n in range(1, max(map(len, grams), default=0) + 1):
            own = sorted({g[:n] for g in grams if len(g) >= n}) if n > 1 else letters
            key = np.array([begun[g[:-1]] * self.width + int(self.letter[ord(g[-1])]) for g in own] if n > 1 else [], np.int64)
            order = np.argsort(key)
            if n > 1:
                own, key = [own[i] for i in order], key[order]
            is_gram = np.array([-1, *(number.get(g, -1) for g in own)], np.int64)
            twice = np.array([False, *(g in number and _repeats(g) for g in own)])
            table = None
            if n > 1 and (len(begun) + 1) * self.width <= self.TABLE:
                table = np.zeros((len(begun) + 1) * self.width, np.int64)
                table[key] = np.arange(1, len(own) + 1)
            self.steps.append((table, key, is_gram, twice))
            begun = {g: i for i, g in enumerate(own, 1)}

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row a text, a column a gram."""
        out, at = np.zeros((len(texts), self.size), np.int64), 0
        while at < len(texts):
            end, places = at, 0
            while end < len(texts) and (end == at or places + len(texts[end]) < self.PLACES):
                places += len(texts[end]) + 1
                end += 1
            out[at:end] = self._counts(texts[at:end])
            at = end
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        points = np.frombuffer(self.between.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points].astype(np.int64)
        row = np.repeat(np.arange(len(texts)) * self.size, [len(t) + 1 for t in texts])
        begun, cells, again = letter, [], []
        for n, (table, key, is_gram, twice) in enumerate(self.steps, 1):
            if n > len(letter):
                break
            if n > 1:
                place = begun[:-1] * self.width + letter[n - 1 :]
                if table is not None:
                    begun = table[place]
                else:
                    found = np.minimum(np.searchsorted(key, place), len(key) - 1)
                    begun = np.where(key[found] == place, found + 1, 0)
            gram = is_gram[begun]
            at = np.flatnonzero(gram >= 0)
            cells.append(row[at] + gram[at])
            # A gram that can overlap itself occurs fewer times apart.
            at = at[twice[begun[at]]]
            for k in range(1, n):
                at = at[np.searchsorted(at, k) :]
                near = at[begun[at] == begun[at - k]]
                again.append(row[near] + gram[near])
        out = np.bincount(np.concatenate(cells), minlength=len(texts) * self.size) if cells else np.zeros(len(texts) * self.size, np.int64)
        for cell in np.unique(np.concatenate(again)).tolist() if again else ():
            out[cell] = texts[cell // self.size].count(self.grams[cell % self.size])
        return out.reshape(len(texts), -1)


_COUNTER: list[tuple[tuple[str, ...], GramCounter]] = []


def counter_of(grams: list[str]) -> GramCounter:
    """The worker's counter of these grams, made once."""
    if not _COUNTER or _COUNTER[0][0] != tuple(grams):
        _COUNTER[:] = [(tuple(grams), GramCounter(grams))]
    return _COUNTER[0][1]


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "field", "len", "grams", "tf"]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            got = [gram_counts(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([g for g, _ in got], pa.list_(pa.string())), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=names)


def _post_some(grams: list[str]):
    """As ``_post``, of some grams alone."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, all_ = ["id", "field", "len", "grams", "tf"], pa.array(grams, pa.string())
        step = max(1, min(256, (1 << 21) // max(1, len(grams))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tf = counter_of(grams).counts(part.column(2).to_pylist())
                row, gram = np.nonzero(tf)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (all_.take(pa.array(gram)), pa.array(tf[row, gram].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *lists], names=names)

    return post


def spelled(docs: DataFrame, fields: dict[str, Column], grams: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``id, field, text, len`` of the fields that aren't null, and ``gram, field, id, tf, len`` of their grams (one row without a gram where a text has none).

    With ``grams`` of these alone: those of a batch of requests, for an index that is made for it."""
    ship(docs.sparkSession)
    text = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.lower(c).alias("text")) for name, c in fields.items())))
    rows = spread(docs.select("id", text.alias("f")).select("id", "f.field", "f.text").filter("text is not null"))
    n = F.char_length("text")
    size = sum((F.greatest(F.lit(0), n - (k - 1)) for k in range(LOW, HIGH + 1)), F.lit(0)).cast("long")
    rows = rows.withColumn("len", size)
    found = rows.mapInArrow(_post if grams is None else _post_some(grams), "id string, field string, len long, grams array<string>, tf array<int>")
    # Of a text one row goes over from Python; its grams are spelled out here.
    found = found.select("id", "field", "len", F.explode_outer(F.arrays_zip("grams", "tf")).alias("g"))
    return rows, found.select(F.col("g.grams").alias("gram"), "field", "id", F.col("g.tf").alias("tf"), "len")


def by_gram(found: DataFrame) -> DataFrame:
    """Postings as they are written: sorted by gram in each file, a common gram dealt over several."""
    return found.repartition("gram", F.pmod(F.xxhash64("id"), F.lit(SALT))).sortWithinPartitions("gram")


def any_of(tests: list[Column]) -> Column:
    """One condition of many, as a tree that isn't deep."""
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def named(table: DataFrame, grams: list[str] | None) -> DataFrame:
    """Rows of some grams, read without the pages that have none of them; all rows if there are too many grams to name."""
    if not grams:
        return table
    # Equalities, as the reader skips pages by them, and not by long lists.
    return table.filter(any_of([F.col("gram") == g for g in sorted(grams)]))


def few_names(grams: DataFrame) -> list[str] | None:
    """The grams of a request batch, if they are ``NAMED`` at most."""
    found = [r["gram"] for r in grams.select("gram").distinct().limit(NAMED + 1).collect()]
    return found if 0 < len(found) <= NAMED else None


#: Grams of a batch for which an index of its own is made at most.
BATCH_GRAMS = 20_000


def grams_of(spelt: DataFrame) -> list[str] | None:
    """The grams of a batch's words (rows with ``grams``) in order, if they are ``BATCH_GRAMS`` at most: an index made for the batch needs no others."""
    found = [r["gram"] for r in spelt.select(F.explode("grams").alias("gram")).distinct().limit(BATCH_GRAMS + 1).collect()]
    return sorted(found) if len(found) <= BATCH_GRAMS else None


class TextIndex:
    """An index in a folder."""

    #: The table that is written last.
    last = "sizes"

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.grams, self.sizes = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "grams", "sizes"))
        self.path = path

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, Column], path: str, grams: list[str] | None = None) -> TextIndex:
        """Index the fields of all rows (``id`` and what the fields are made of).  Null fields are no texts.  With ``grams`` postings of these alone are written."""
        spark = docs.sparkSession
        rows, found = spelled(docs, fields, grams)
        by_gram(found).write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        written.filter("gram is not null").groupBy("gram", "field").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/grams")
        rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(spark, path)

    @classmethod
    def open(cls, docs: DataFrame, fields: dict[str, Column], path: str, grams: list[str] | None = None) -> TextIndex:
        """The index in a folder; made if it isn't there or isn't whole."""
        spark = docs.sparkSession
        return cls(spark, path) if exists(spark, f"{path}/{cls.last}/_SUCCESS") else cls.build(docs, fields, path, grams)

    @classmethod
    def of(cls, docs: DataFrame, fields: dict[str, Column], grams: list[str] | None = None) -> TextIndex:
        """The index of a table's files as they are now, made once for each state of them (and for the ``grams`` of a batch)."""
        state = repr((grams, cls.__name__, mended(docs), sorted((k, str(c)) for k, c in fields.items()), docs.schema.json(), docs._jdf.queryExecution().analyzed().canonicalized().semanticHash()))
        return cls.open(docs, fields, f"{shared_dir(docs.sparkSession)}/mnemospark/index-{hashlib.sha256(state.encode()).hexdigest()[:32]}", grams)

    def having(self, grams: DataFrame) -> DataFrame:
        """Postings, at least those of some grams: of a few grams, the scan reads no others."""
        return named(self.postings, few_names(grams))

    def frequencies(self, grams: DataFrame) -> DataFrame:
        """``gram, field, df``, at least of some grams."""
        return self.grams
