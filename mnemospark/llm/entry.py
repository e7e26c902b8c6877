"""Queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bsi_topk, chat, chunk_dedup, decontam, merkle, minhash, mixing, mixlm, rule_quality, sharding, simhash, template_extract
from .common import table

MIX = mixing.MixPlan(
    domains={
        "web": (5, tuple(f"src{i}" for i in range(8))),
        "books": (3, tuple(f"src{i}" for i in range(8, 14))),
        "code": (2, tuple(f"src{i}" for i in range(14, 20))),
    },
    languages={"en": 4, "de": 2, "fr": 2, "es": 2},
)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi_topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op2_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = template_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its passages of ``SPAN_WORDS`` words or more that recur in others, and beside them the shorter ones (``short_``)."""
    documents = table(spark, sf_dir, "documents")
    spans = chunk_dedup.repeated_spans(documents, across=True, min_words=0).withColumn("bytes", F.col("stop") - F.col("start"))
    long = F.col("n_words") >= chunk_dedup.SPAN_WORDS
    found = spans.groupBy("doc_id").agg(
        F.count_if(long).alias("n_spans"), F.sum(F.when(long, F.col("n_words"))).alias("repeated_words"), F.max(F.when(long, F.col("n_words"))).alias("longest_words"),
        F.sum(F.when(long, F.col("bytes"))).alias("repeated_bytes"), F.min(F.when(long, F.col("first_id"))).alias("first_doc_id"), F.max(F.when(long, F.col("copies"))).alias("copies"),
        F.count_if(~long).alias("short_spans"), F.sum(F.when(~long, F.col("n_words"))).alias("short_words"), F.sum(F.when(~long, F.col("bytes"))).alias("short_bytes"),
    )
    counts = [c for c in found.columns if c not in ("doc_id", "first_doc_id")]
    return documents.select("doc_id").distinct().join(found, "doc_id", "left").fillna(0, counts)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = rule_quality.train(documents, table(spark, sf_dir, "labels"))
    out = rule_quality.score(documents, model, ["doc_id"])
    return out.select("doc_id", (rule_quality.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_FLOOR).cast("int").alias("predicted"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), "doc_id", "text", shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = rule_quality.remainder(F.col("doc_id"), 7) == 2
    out = mixlm.score_texts(table(spark, sf_dir, "documents"), ~held_out, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.manifest(documents, fields, "lang", "doc_id", {"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups != "", F.sha2(groups, 256)).otherwise("")
    out = alignment.align(table(spark, sf_dir, "documents"), shown=digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUALITY_FLOOR = 0.7
CONFLICT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text")
    )
    out = chat.format_conversations(rows.unionByName(extra))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_mask"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_extract_main_text, op3_chunk_dedup, op4_mix_sources, op5_quality_rules, op6_minhash_dedup, op7_decontaminate, op8_shard_documents, op9_chat_format, op10_context_mixing, op11_simhash_dedup, op12_merkle_manifest, op13_token_alignment)}


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in names)


def _case(column: str, weights: dict[str, int], other: int) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {other} END AS BIGINT)" if weights else f"CAST({other} AS BIGINT)"


def _fill_sql(source: str, parent: str, name: str) -> str:
    return f"""
      SELECT *, CASE WHEN full_ THEN supply ELSE upto * rest // nullif(open_, 0) - (upto - weight) * rest // nullif(open_, 0) END AS share FROM (
        SELECT *, budget - coalesce(sum(CASE WHEN full_ THEN supply END) OVER (PARTITION BY {parent}), 0) AS rest,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {name} ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT *, supply * w_ <= weight * (budget - c_) AS full_ FROM (
          SELECT *, coalesce(sum(supply) OVER (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_,
            sum(weight) OVER (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_ FROM ({source}))))"""


def _mix_sql(p: mixing.MixPlan) -> str:
    domain = "CASE " + " ".join(f"WHEN source IN ({_in(s)}) THEN '{k}'" for k, (_, s) in p.domains.items()) + " ELSE 'other' END"
    return f"""
    WITH d AS (SELECT *, {domain} AS domain FROM (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents) WHERE n_tokens > 0),
    leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {p.max_epochs} AS supply FROM d GROUP BY ALL),
    dom AS ({_fill_sql(f"SELECT domain, 0 AS root, sum(supply) AS supply, {_case('domain', {k: w for k, (w, _) in p.domains.items()}, p.other)} AS weight, (SELECT sum(tokens) * {p.budget_percent} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain", "root", "domain")}),
    lng AS ({_fill_sql(f"SELECT l.*, dom.share AS budget FROM (SELECT domain, lang, sum(supply) AS supply, {_case('lang', p.languages, p.other)} AS weight FROM leaf GROUP BY domain, lang) l JOIN dom USING (domain)", "domain", "lang")}),
    lf AS ({_fill_sql(f"SELECT leaf.*, {_case('source', p.sources, p.other)} AS weight, lng.share AS budget FROM leaf JOIN lng USING (domain, lang)", "domain, lang", "source")}),
    e AS (SELECT d.*, share // tokens AS epochs, share % tokens AS part FROM d JOIN lf USING (domain, lang, source)),
    h AS (SELECT *, ('0x' || substr(md5('{p.seed}|' || epochs::BIGINT || '|' || doc_id), 1, 8))::BIGINT AS h FROM e),
    b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(greatest(least(n_tokens, part - before), 0) AS BIGINT) AS taken FROM b
    WHERE epochs > 0 OR part > before"""


OP9_SQL = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONFLICT}'), (-1, 1, 'assistant', '{CONFLICT}'))),
    t AS (SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST') OR contains(text, '[/INST]') OR contains(text, '<<SYS>>') OR contains(text, '<</SYS>>') OR contains(text, '<|') AS esc,
        length(replace(replace(replace(role, '\\', '\\s'), '<', '\\l'), '[', '\\b')) + length(role) - length(replace(role, ']', '')) AS role_chars FROM c),
    u AS (SELECT *, length(text) + CASE WHEN esc THEN 3 * length(text) - length(replace(text, '\\', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) + 1 ELSE 0 END + role_chars + 14 AS chars FROM t),
    g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l, sum(chars) + 7 AS f FROM u GROUP BY conv_id)
    SELECT conv_id, n AS n_turns, sha256(a) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

OP1_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP6_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {minhash.SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {minhash.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {minhash.SHINGLE - 1}], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    x AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
    n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= {minhash.PERCENT} * (u.n + v.n - c)),
    r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
    k AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN k USING (doc_id)"""

OP7_SQL = rf"""
    WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    n AS (SELECT *, least(len(w), {decontam.WINDOW}) AS n FROM i WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
    d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT d.*, m.n, unnest(range(1, len(w) - m.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) m WHERE len(w) >= m.n)),
    h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN win USING (n, g)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS a FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(a, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text: bytes of the reflected polynomial, eight shifts each."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_reduce([{step}, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"


def _merkle_sql(levels: int = 6) -> str:
    """Levels one below the other, as far as 8 to their power rows; ``s`` and ``p`` of a level are a node's siblings to the left and right."""
    enc = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
    leaf = lambda t: "sha256(" + " || ".join([enc("doc_id", "doc_id::VARCHAR"), enc("source", "source"), enc("lang", "lang"), enc("n_chars", "n_chars::VARCHAR"), enc("text", t)]) + ")"

    def tree(name: str, key: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            out.append(f"{name}s{k} AS (SELECT {key}, i, d, CASE WHEN n > 1 THEN i // 8 ELSE i END AS up, n, "
                       f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, "
                       f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT {key}, up AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n FROM {name}s{k} GROUP BY {key}, up, n)")
        return out

    down, proof = "", []
    ups = []
    for name, on in (("x", "x0.g"), ("y", "'-'")):
        for k in range(levels):
            alias = f"{name}s{k}"
            here = "x0.i" if (name, k) == ("x", 0) else ("z.i" if k == 0 else f"{ups[-1]}.up")
            down += f" JOIN {alias} ON {alias}.g = {on} AND {alias}.i = {here}"
            if (name, k) == ("x", levels - 1):
                down += f" JOIN x{levels} AS e ON e.g = x0.g JOIN y0 AS z ON z.k = x0.g"
            ups.append(alias)
            proof.append(f"{alias}.l || {alias}.r")
    names = [*(f"xs{k}" for k in range(levels)), *(f"ys{k}" for k in range(levels))]
    stages = ["f0 AS (SELECT p.*, coalesce(t, leaf) AS f FROM path p)"]
    for j, a in enumerate(names):
        stages.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {a}_l || {a}_r = '' AND NOT {a}_m THEN f ELSE sha256({a}_l || f || {a}_r) END AS f) FROM f{j})")
    cols = ", ".join(f"{a}.l AS {a}_l, {a}.r AS {a}_r, {a}.n > 1 AS {a}_m" for a in names)
    text = f"CASE WHEN doc_id IS NOT NULL AND {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    first = "SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, d, t, doc_id, count(*) OVER (PARTITION BY g) AS n FROM leaves"
    tops = f"SELECT '-' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS k, count(*) OVER () AS n FROM x{levels}"
    ctes = [
        f"docs AS (SELECT *, {text} AS changed FROM documents)", f"leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS d, {leaf('changed')} AS t FROM docs)",
        *tree("x", "g", first), *tree("y", "g", tops),
        f"path AS (SELECT x0.doc_id, x0.d AS leaf, x0.t, e.d AS subroot, w.d AS root, {' || '.join(proof)} AS proof, {cols} FROM x0{down} CROSS JOIN y{levels} AS w)", *stages,
    ]
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(names)}"


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": _merkle_sql(), "op1_topk_search": OP1_SQL, "op4_mix_sources": _mix_sql(MIX), "op6_minhash_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL, "op9_chat_format": OP9_SQL}
