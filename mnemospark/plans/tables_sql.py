"""The derived tables of ``sources.fixtures`` as SQL for DuckDB."""

from __future__ import annotations

from ..schema import NIL
from ..sources.fixtures import AS_OF, PROJECT, TAGS

AT = f"TIMESTAMP '{AS_OF}'"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def uid(n: str) -> str:
    return f"('00000000-0000-4000-8000-' || lpad(CAST({n} AS VARCHAR), 12, '0'))"


CREATED = f"({AT} - to_days(CAST((doc_id * 37) % 240 AS INTEGER)) - to_hours(CAST(doc_id % 24 AS INTEGER)))"

MEMORIES = f"""memories AS (
  SELECT {uid('doc_id')} AS id, (['conversation', 'knowledge', 'decision', 'preference', 'context'])[doc_id % 5 + 1] AS memory_type, text AS content,
    CASE WHEN doc_id % 20 = 19 THEN NULL WHEN source = 'src0' THEN '{NIL}' ELSE {uid("CAST(regexp_extract(source, '[0-9]+') AS BIGINT) + 1000000")} END AS project_id,
    CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, ({_list(TAGS)})[doc_id % 9 + 1]] END AS tags, CAST(quality AS VARCHAR) AS priority,
    (['user', 'system', 'inferred', 'external'])[doc_id % 4 + 1] AS source, (['project', 'global', 'workspace'])[doc_id % 3 + 1] AS scope,
    {CREATED} AS created_at, coalesce(last, {CREATED}) AS last_accessed, coalesce(times, 0) AS access_count, (doc_id * 7 % 100) / 100.0::DOUBLE AS importance,
    doc_id % 17 = 0 AS is_deleted, CASE WHEN doc_id % 17 = 0 THEN {AT} - to_days(CAST((doc_id * 13) % 60 AS INTEGER)) END AS deleted_at
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)
    LEFT JOIN (SELECT user_id AS doc_id, max(ts) AS last, count(*) AS times FROM events GROUP BY user_id) USING (doc_id))"""

EMBEDDINGS = f"embs AS (SELECT {uid('vec_id')} AS id, embedding FROM embeddings)"

VECTORS = f"""{EMBEDDINGS}, vectors AS (SELECT e.id, CAST(embedding AS DOUBLE[]) AS embedding, project_id, memory_type, tags, substr(content, 1, 200) AS preview, importance FROM embs e JOIN memories m ON e.id = m.id)"""

REQUESTS = f"""requests AS (SELECT qid, q, w[1] || ' ' || w[(len(w) + 1) // 2] || ' ' || w[len(w)] AS words, CASE qid // 20 % 4 WHEN 3 THEN NULL WHEN 2 THEN '{NIL}' ELSE '{PROJECT}' END AS project, qid // 20 % 4 IN (0, 2) AS include_global FROM
  (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0) JOIN
  (SELECT item_id * 20 AS qid, string_split_regex(trim(regexp_replace(lower(text), '[.,]', '', 'g')), '\\s+') AS w FROM benchmark) USING (qid))"""

CHUNKS = f"""chunks AS (SELECT {uid('conv_id * 100 + turn + 2000000')} AS id, {uid('conv_id + 3000000')} AS chunk_group_id, turn AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS chunk_total,
  text AS content, [role] AS tags, (turn * 13 % 100) / 100.0::DOUBLE AS importance FROM conversations)"""

OPLOG = f"""oplog AS (
  SELECT doc_id AS seq, {CREATED} AS ts, 'add' AS op, {uid('doc_id')} AS id, source AS value FROM documents
  UNION ALL SELECT doc_id + 1000000, {CREATED} + to_days(1), 'delete', {uid('doc_id')}, NULL FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT doc_id + 2000000, {CREATED} + to_days(2), 'delete', {uid('doc_id')}, NULL FROM documents WHERE doc_id % 51 = 0
  UNION ALL SELECT doc_id + 3000000, {CREATED} + to_days(3), 'tag', {uid('doc_id')}, 'pinned' FROM documents WHERE doc_id % 13 = 0)"""


def hours(later: str, earlier: str) -> str:
    return f"CAST(trunc((epoch_us({later}) - epoch_us({earlier})) / 3600000000) AS BIGINT)"


def days(later: str, earlier: str) -> str:
    return f"CAST(trunc((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


def knn(k: int = 10, min_score: float = 0.2, where: str = "true", name: str = "vec") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM
  (SELECT qid, v.id, round(list_cosine_similarity(embedding, q), 9) AS score FROM vectors v, requests r WHERE {where}) WHERE score >= {min_score}) WHERE rank <= {k})"""


VECTOR_SCOPE = f"(project IS NULL OR coalesce(project_id = project, false) OR (include_global AND coalesce(project_id = '{NIL}', false)))"
TEXT_SCOPE = "(project IS NULL OR coalesce(project_id = project, false) OR include_global)"


def bm25(fields: dict[str, str]) -> str:
    docs = " UNION ALL ".join(f"SELECT id, '{name}' AS field, lower({c}) AS text FROM memories" for name, c in fields.items())
    return f"""
f AS (SELECT *, CASE WHEN length(text) >= 4 THEN 3 * length(text) - 6 ELSE greatest(0, length(text) - 1) + greatest(0, length(text) - 2) END AS len FROM ({docs})),
size AS (SELECT field, count(*) AS n, avg(len) AS avg_len FROM f GROUP BY field),
w AS (SELECT qid, unnest(string_split_regex(trim(lower(words)), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(lower(words)), '\\s+'), 1) AS place FROM requests),
wd AS (SELECT DISTINCT word FROM w WHERE length(word) >= 2),
wg AS (SELECT word, substr(word, i, k) AS gram FROM (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM wd, (VALUES (2), (3), (4)) t(k) WHERE length(word) >= k)),
g AS (SELECT DISTINCT gram FROM wg),
seen AS (SELECT id, field, gram, (length(text) - length(replace(text, gram, ''))) / length(gram) AS tf, len FROM f, g WHERE contains(text, gram)),
df AS (SELECT field, gram, count(*) AS df FROM seen GROUP BY ALL),
idf AS (SELECT field, word, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM wg JOIN df USING (gram) JOIN size USING (field) GROUP BY ALL),
x AS (SELECT word, gram, count(*) OVER (PARTITION BY word) AS need FROM (SELECT DISTINCT word, gram FROM wg)),
m AS (SELECT s.id, s.field, x.word, min(tf) AS tf, min(len) AS len FROM seen s JOIN x USING (gram) GROUP BY s.id, s.field, x.word, need HAVING count(*) = need),
bm AS (SELECT w.qid, m.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM m JOIN idf USING (field, word) JOIN size USING (field) JOIN w USING (word) GROUP BY ALL),
txt_all AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm)"""


def text_hits(k: int = 10, mode: str = "parity", name: str = "txt") -> str:
    if mode == "parity":
        return f"{name} AS (SELECT t.qid, t.id, score, rank FROM txt_all t JOIN memories USING (id) JOIN requests USING (qid) WHERE rank <= {k} AND {TEXT_SCOPE})"
    return f"""{name} AS (SELECT * FROM (SELECT t.qid, t.id, score, CAST(row_number() OVER (PARTITION BY t.qid ORDER BY score DESC, t.id) AS INTEGER) AS rank
  FROM bm t JOIN memories USING (id) JOIN requests USING (qid) WHERE {TEXT_SCOPE}) WHERE rank <= {k})"""


def fused(alpha: float = 0.5, mode: str = "parity") -> str:
    up = "(score - min(score) OVER (PARTITION BY qid)) / nullif(CASE WHEN max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) < 1.1920929e-07 THEN 0 ELSE max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid) END, 0)"
    vec = f"1 - {up}" if mode == "parity" else up
    return f"""fus AS (SELECT qid, id, round(sum(s), 9) AS score, max(v) AS in_vector FROM (
  SELECT qid, id, coalesce({vec}, 1.0) * {alpha} AS s, true AS v FROM vec UNION ALL SELECT qid, id, coalesce({up}, 1.0) * (1 - {alpha}) AS s, false AS v FROM txt) GROUP BY qid, id)"""


def mmr(source: str, lam: float = 0.5, k: int = 10) -> str:
    """CTEs ``c`` and ``pick``; needs WITH RECURSIVE.  ``source`` has qid, id, score, text."""
    return f"""c AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS tokens, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM {source}),
jac AS (SELECT a.qid, a.id, b.id AS other, len(list_intersect(a.tokens, b.tokens)) / greatest(1, len(list_distinct(list_concat(a.tokens, b.tokens)))) AS j FROM c a JOIN c b ON a.qid = b.qid),
pick AS (SELECT qid, 0 AS rank, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS id FROM c GROUP BY qid
  UNION ALL SELECT qid, rank + 1, list_append(done, id2), id2 FROM (
    SELECT p.qid, p.rank, p.done, c.id AS id2, row_number() OVER (PARTITION BY p.qid, p.rank ORDER BY
      round({lam} * c.score - (1 - {lam}) * coalesce((SELECT max(j) FROM jac WHERE jac.qid = c.qid AND jac.id = c.id AND list_contains(p.done, jac.other)), 0), 9) DESC, c.place) AS r
    FROM pick p JOIN c ON c.qid = p.qid WHERE p.rank < {k} AND NOT list_contains(p.done, c.id)) WHERE r = 1)"""
