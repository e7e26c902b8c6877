"""Scores, similarities and text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ImportanceConfig, SearchConfig

EPSILON = 1.1920929e-07

# Weights of tags in the importance score.
TAG_WEIGHTS = {"critical": 1.0, "decision": 0.9, "key": 0.8, "important": 0.7, "config": 0.6, "reference": 0.5, "note": 0.4, "temporary": 0.2, "draft": 0.1}

# Words that mark decisions and conclusions.
DECISION_WORDS = ("决定", "选择", "采用", "最终方案", "确定", "decided", "chosen", "selected", "final", "determined")
CONCLUSION_WORDS = ("结论", "因此", "最终", "总结", "综上", "conclusion", "therefore", "finally", "summary", "in summary")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector has no length.  Norms may be given where they are known."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def preview(content: Column, chars: int = 200) -> Column:
    return F.substring(content, 1, chars)


def token_set(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def ngram_count(text: Column, low: int = 2, high: int = 4) -> Column:
    """How many character n-grams a text has."""
    n = F.char_length(text)
    out = F.lit(0)
    for k in range(low, high + 1):
        out = out + F.greatest(F.lit(0), n - (k - 1))
    return out.cast("long")


#: Parameters of BM25: how soon repeats stop counting, and how much a text's length does.
K1, B = 1.2, 0.75


def bm25_part(idf: Column, tf: Column, length: Column, avg_length: Column) -> Column:
    """What one word of some weight scores in one text."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def occurrences(text: Column, part: Column) -> Column:
    """How often a text has a part, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")


def ngrams(word: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of a word, repeats kept."""
    def of(k: int) -> Column:
        n = F.char_length(word) - (k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(k) for k in range(low, high + 1)))


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("HOUR", earlier, later)


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("DAY", earlier, later)


def time_decay(score: Column, created_at: Column, scope: Column, as_of: Column, config: SearchConfig = SearchConfig()) -> Column:
    """Halves a score every half-life; evergreen scopes don't age."""
    aged = score * F.exp(-F.log(F.lit(2.0)) / config.half_life_hours * hours_between(as_of, created_at))
    return F.when(scope.isin(*config.evergreen), score).otherwise(aged)


def source_weight(source: Column, config: SearchConfig = SearchConfig()) -> Column:
    w = config.weights
    return F.when(source == "user", w.user).when(source == "system", w.system).when(source == "inferred", w.inferred).when(source == "external", w.external)


def applied_score(score: Column, created_at: Column, scope: Column, source: Column, as_of: Column, config: SearchConfig = SearchConfig()) -> Column:
    return time_decay(score, created_at, scope, as_of, config) * source_weight(source, config)


_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


def importance(tags: Column, metadata: Column, last_accessed: Column, access_count: Column, as_of: Column, config: ImportanceConfig = ImportanceConfig()) -> Column:
    """Recency, frequency, tags and explicit priority, weighted and clamped to 0..1 (NaN stays)."""
    recency = F.exp(-config.decay * days_between(as_of, last_accessed))
    frequency = F.log(access_count + 1.0) / config.frequency_normalize
    weights = F.create_map(*(F.lit(x) for kv in TAG_WEIGHTS.items() for x in kv))
    semantic = F.greatest(F.lit(0.5), F.coalesce(F.array_max(F.transform(tags, lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(0.5)))), F.lit(0.5)))
    raw = F.try_element_at(metadata, F.lit("priority"))
    explicit = F.coalesce(F.when(F.lower(raw).rlike(_NUMBER), raw.try_cast("float").cast("double")), F.lit(0.5))
    score = config.weight_recency * recency + config.weight_frequency * frequency + config.weight_semantic * semantic + config.weight_explicit * explicit
    return F.when(F.isnan(score), score).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def list_scope(project_id: Column, project_only: bool = False, global_only: bool = False, project: str | None = None, nil: str = "") -> Column:
    if project_only:
        return (project_id == project) if project else (project_id.isNotNull() & (project_id != nil))
    if global_only:
        return project_id.isNull() | (project_id == nil)
    return F.lit(True)


def vector_scope(project_id: Column, wanted: Column, include_global: Column, nil: str) -> Column:
    """Rows a vector search sees: of the project, or global ones beside it."""
    return wanted.isNull() | F.coalesce(project_id == wanted, F.lit(False)) | (include_global & F.coalesce(project_id == nil, F.lit(False)))


def text_scope(project_id: Column, wanted: Column, include_global: Column) -> Column:
    """Rows a text search sees: with global ones included, those of all projects."""
    return wanted.isNull() | F.coalesce(project_id == wanted, F.lit(False)) | include_global


def soft_delete_expired(deleted_at: Column, as_of: Column, days: int = 30) -> Column:
    return days_between(as_of, deleted_at) > days


def preprocess(content: Column, longest: int = 8000, shortest: int = 10) -> Column:
    """NUL removed, trimmed, cut, and emptied where too short to be embedded."""
    text = F.trim(F.replace(content, F.lit("\0"), F.lit("")))
    text = F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("...[截断]"))).otherwise(text)
    return F.when(F.char_length(text) < shortest, F.lit("")).otherwise(text)


def mentions(content: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | content.contains(w)
    return out
