"""Quality classifier: a sparse ensemble of rules over text statistics (RuleFit).

Statistics of whole texts are one row of numbers.  Shallow trees are boosted on a bounded sample of labelled
rows; each path from a root is a rule, a conjunction of comparisons.  A logistic model with an L1 penalty
keeps few of the rules.  The model is then one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import arrow_map

#: Labelled rows that a model is fitted on, at most: those of the smallest seeded hashes.
TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 32, 3, 40, 0.15
PENALTY = 0.0005

#: Statistics that are shares of bytes.
_CLASSES = {
    "upper": textkit.byte_table((65, 90)),
    "lower": textkit.byte_table((97, 122)),
    "digit": textkit.byte_table((48, 57)),
    "space": textkit.SPACES,
    "newline": textkit.byte_table((10, 10)),
    "beyond_ascii": textkit.byte_table((128, 255)),
    "stops": textkit.byte_table((33, 33), (46, 46), (63, 63)),
    "commas": textkit.byte_table((44, 44), (58, 59)),
    "bangs": textkit.byte_table((33, 33)),
    "bars": textkit.byte_table((124, 124)),
    "markup": textkit.byte_table((60, 60), (62, 62), (91, 91), (93, 93), (123, 123), (125, 125), (92, 92)),
    "symbols": textkit.byte_table((35, 38), (42, 43), (47, 47), (61, 61), (64, 64), (94, 96), (126, 126)),
    "control": textkit.byte_table((0, 8), (14, 31), (127, 127)),
}
STATISTICS = [
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "doubled_words", "distinct_fives", "lines", "distinct_lines", *_CLASSES,
]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """Texts x STATISTICS.  Shares of an empty text are 0."""
    data, offsets = textkit.texts_of(texts)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    at = {name: i for i, name in enumerate(STATISTICS)}
    size = np.diff(offsets)
    # Byte shares in pieces of bounded size, whatever the lengths of texts.
    for a in range(int(offsets[0]), int(offsets[-1]), 1 << 22):
        b = min(a + (1 << 22), int(offsets[-1]))
        bounds = np.clip(offsets, a, b) - a
        for name, table in _CLASSES.items():
            out[:, at[name]] += _per_text(table[data[a:b]], bounds)
    for name in _CLASSES:
        out[:, at[name]] /= np.maximum(size, 1)
    out[:, at["log_bytes"]] = np.log1p(size)
    for g in textkit.words_of(data, offsets):
        lengths = g.ends - g.starts
        base = int(offsets[g.first])
        for i in range(g.first, g.last):
            a, b = g.bounds[i - g.first], g.bounds[i - g.first + 1]
            n = b - a
            row = out[i]
            row[at["log_words"]] = np.log1p(n)
            text = data[offsets[i] : offsets[i + 1]]
            breaks = np.flatnonzero(text == 10)
            row[at["lines"]] = (len(breaks) + 1) / max(len(text), 1)
            row[at["distinct_lines"]] = 1.0
            if not n:
                continue
            h = g.hashes[a:b]
            row[at["word_length"]] = lengths[a:b].mean()
            row[at["longest_word"]] = np.log1p(lengths[a:b].max())
            _, counts = np.unique(h, return_counts=True)
            row[at["distinct_words"]] = len(counts) / n
            row[at["commonest_word"]] = counts.max() / n
            row[at["doubled_words"]] = (h[1:] == h[:-1]).sum() / n
            if n >= 5:
                fives = h[:-4] + h[1:-3] * np.uint64(3) + h[2:-2] * np.uint64(5) + h[3:-1] * np.uint64(7) + h[4:] * np.uint64(9)
                row[at["distinct_fives"]] = len(np.unique(fives)) / (n - 4)
            else:
                row[at["distinct_fives"]] = 1.0
            if len(breaks):
                # A line's hash: the sum of its words' hashes, each weighted by its place in the line.
                line = np.searchsorted(breaks + (int(offsets[i]) - base), g.starts[a:b])
                heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
                place = np.arange(n) - np.repeat(heads, np.diff(np.concatenate((heads, [n]))))
                keys = np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), heads)
                row[at["distinct_lines"]] = len(np.unique(keys)) / len(keys)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(batch.num_columns - 1))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=[*batch.schema.names[:-1], *STATISTICS])


def with_statistics(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Columns ``keep`` of ``df`` and the statistics of its texts."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    types = [dict(df.dtypes)[c] for c in keep]
    schema = ", ".join([*(f"_k{i} {t}" for i, t in enumerate(types)), *(f"{s} double" for s in STATISTICS)])
    out = arrow_map(df.select(*kept, F.col(text_col).cast("string").alias("_text")), _measure, schema)
    return out.withColumnsRenamed({f"_k{i}": f"_kept_{c}" for i, c in enumerate(keep)})


@dataclass(frozen=True)
class Rule:
    """All of (statistic, threshold, above): the statistic is over the threshold, or not."""

    conditions: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, t, above in self.conditions:
            out &= (x[:, f] > t) == above
        return out

    def column(self, prefix: str = "") -> Column:
        out = None
        for f, t, above in self.conditions:
            c = F.col(prefix + STATISTICS[f]) > F.lit(t)
            c = c if above else ~c
            out = c if out is None else out & c
        return out


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        terms = [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        while len(terms) > 1:  # a balanced sum, or the expression would be as deep as the model is long
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        z = F.lit(self.intercept) + terms[0] if terms else F.lit(self.intercept)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], rows: np.ndarray) -> list[tuple[tuple[tuple[int, float, bool], ...], np.ndarray, float]]:
    """Nodes of one tree but its root: path, rows, value (of leaves; else 0)."""
    out = []
    todo = [((), rows)]
    while todo:
        path, at = todo.pop()
        g, h = grad[at], hess[at]
        best = (1e-6, None, None)
        if len(path) < DEPTH and len(at) >= 20:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gs, hs = np.bincount(binned[at, f], g, len(e) + 1).cumsum()[:-1], np.bincount(binned[at, f], h, len(e) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            if path:
                out.append((path, at, float(g.sum() / (h.sum() + 1))))
            continue
        _, f, k = best
        above = binned[at, f] > k
        if path:
            out.append((path, at, 0.0))
        for side in (False, True):
            todo.append(((*path, (f, float(edges[f][k]), side)), at[above == side]))
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Paths of boosted trees, without those that hold for the same rows as an earlier one."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    z = np.full(len(y), np.log(rate / (1 - rate)))
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        sample = np.flatnonzero(rng.random(len(y)) < 0.6)
        for path, _, value in _tree(binned, y - p, p * (1 - p), edges, sample):
            rule = Rule(path)
            held = rule.holds(x)
            if 0 < held.sum() < len(y):
                rules.setdefault(np.packbits(held).tobytes(), rule)
            z += RATE * value * held
    return list(rules.values())


def fit_lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    n = len(y)
    mean, scale = a.mean(axis=0), np.maximum(a.std(axis=0), 0.05)
    a = ((a - mean) / scale).astype(np.float32)
    v = np.ones(a.shape[1], dtype=np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (0.25 * (float(np.linalg.norm(a @ v)) ** 2 / n) * 1.05 + 0.25)
    w = u = np.zeros(a.shape[1], dtype=np.float64)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    b = c = float(np.log(rate / (1 - rate)))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ u.astype(np.float32) + c)))
        r = ((p - y) / n).astype(np.float32)
        new = u - step * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * float(r.sum())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    w = w / scale
    return float(b - (w * mean).sum()), w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model; of one class only (or no rows) it has no rules."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(rate / (1 - rate))))
    rules = extract_rules(x, y)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32)
    intercept, w = fit_lasso(a, y)
    return RuleModel(intercept, [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-9])


def remainder(column: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on the ``train_rows`` labelled rows of the smallest hashes among those with crc32(id) mod 4 other than 2.

    The sample, and so what reaches the driver, is bounded by the parameter whatever the size of the tables.
    Labels that are null or whose document is missing take no part; repeated labels count each.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 4) != 2))
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).orderBy(F.md5(F.concat(F.lit("train"), F.col("_id").cast("string"))), "_id", "_label").limit(train_rows)
    # `train_rows` ids at most are broadcast.
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    # Sorted here, not by Spark, which would read the texts once more to find ranges.
    got = with_statistics(rows, ["_id", "_label"], "_t").toArrow().sort_by([(c, "ascending") for c in ("_kept__id", "_kept__label", *STATISTICS)])
    x = np.stack([got[c].to_numpy() for c in STATISTICS], axis=1)
    return fit(x, got["_kept__label"].to_numpy())


def score(df: DataFrame, model: RuleModel, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """Columns ``keep`` (other than ``name``) and the score, for every row: null and empty texts get the score of an empty text,
    repeated rows equal scores, an empty table no rows.  Names of other columns don't matter."""
    out = with_statistics(df, keep, text_col)
    return out.select(*(F.col(f"_kept_{c}").alias(c) for c in keep), model.column().alias(name))


def keep_good(df: DataFrame, model: RuleModel, floor: float, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose score is ``floor`` or more."""
    return score(df, model, df.columns, text_col, "_quality_score").filter(F.col("_quality_score") >= floor).select(*df.columns)
