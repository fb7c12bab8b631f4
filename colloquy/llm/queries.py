"""The registered query of each operator, with production parameters over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_scores import backoff_scores

    return backoff_scores(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fingerprint").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, personal_data

    return digest(personal_data(_table(spark, sf_dir, "documents")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    columns = {"size__": "size", "source_size__": "source_size", "target__": "target", "taken__": "taken"}
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", *[F.col(a).alias(b) for a, b in columns.items()])


def op6_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_search import nearest_codes, sign_code

    codes = _table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(codes, codes.where("id % 100 = 0"), k=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secret_spans

    return digest(secret_spans(_table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, predictions, train

    docs = _table(spark, sf_dir, "documents")
    found = predictions(docs, train(docs, held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, formatted

    turns = _table(spark, sf_dir, "conversations")
    marked = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    return digest(*formatted(turns.select("conv_id", "turn", "role", "text").unionByName(added)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compressed

    return compressed(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_backoff_scores, op2_simhash, op3_pii, op4_embedding_dedup, op5_mixing, op6_hamming_search, op7_packing, op8_secrets, op9_language, op10_licenses,
        op11_chat_formatting, op12_source_divergence, op13_vector_codes,
    )
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _vector_codes(parts: int = 4, rounds: int = 4) -> str:
    """SQL of product codes: a block of common table expressions for each round.  ``dots`` of whole doubles are exact."""
    steps = [
        "x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(1024 * e)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM x, range({parts}) t(part))",
        "b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= 256)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, part, min(apart) AS apart, arg_min(entry, (apart, entry)) AS entry FROM"
            f" (SELECT p.r, p.part, b.entry, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v) AS apart FROM p JOIN b{i} b ON b.part = p.part) GROUP BY r, part)"
        )
        if i < rounds:
            steps.append(
                f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT part, entry, list(v ORDER BY pos) AS v FROM"
                f" (SELECT a.part, a.entry, pos, floor(sum(p.v[pos]) / count(*)) AS v FROM a{i} a JOIN p ON p.r = a.r AND p.part = a.part, range(1, len(p.v) + 1) t(pos) GROUP BY a.part, a.entry, pos) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"
            )
    return f"""
WITH {', '.join(steps)},
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(apart) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(v[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}, range(1, len(v) + 1) t(pos))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM x JOIN c ON c.r = x.r, h"""


ORACLE_SQL: dict[str, str] = {
    "op1_backoff_scores": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT *, lag(c) OVER (PARTITION BY r ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM t),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM g WHERE i > 1 GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE i > 2 GROUP BY a, b, c),
v1 AS (SELECT g.*, n1.n / CAST((SELECT count(*) FROM t) AS DOUBLE) AS v FROM g JOIN n1 ON n1.c = g.c),
v2 AS (SELECT v1.r, v1.i, v1.a, v1.b, v1.c, CASE WHEN i = 1 THEN v WHEN n2.n >= 2 THEN n2.n / CAST(x.n AS DOUBLE) ELSE 0.4::DOUBLE * v END AS v, i > 1 AND n2.n >= 2 AS l2
  FROM v1 LEFT JOIN n2 ON n2.b = v1.b AND n2.c = v1.c LEFT JOIN n1 x ON x.c = v1.b),
v3 AS (SELECT v2.r, v2.i, CASE WHEN i < 3 THEN v WHEN n3.n >= 2 THEN n3.n / CAST(x.n AS DOUBLE) ELSE 0.4::DOUBLE * v END AS v, i > 2 AND n3.n >= 2 AS l3, l2
  FROM v2 LEFT JOIN n3 ON n3.a = v2.a AND n3.b = v2.b AND n3.c = v2.c LEFT JOIN n2 x ON x.b = v2.a AND x.c = v2.b)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(*) FILTER (l3) AS n_full,
  count(*) FILTER ((i = 2 AND NOT coalesce(l2, false)) OR (i > 2 AND NOT coalesce(l3, false))) AS n_backed, CAST(coalesce(sum(CAST(round(ln(v) * 1e6) AS BIGINT)), 0) AS BIGINT) AS logscore_micro
FROM d LEFT JOIN v3 ON v3.r = d.r GROUP BY d.r, d.doc_id, d.w""",
    "op4_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
FROM e LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = e.vec_id""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, total * 2.0::DOUBLE AS cap FROM s),
m AS (SELECT *, ((sum(total) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT min_by(level, cap / w) FILTER (level * w <= cap) AS level FROM m),
t AS (SELECT source, total, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target FROM m, f),
p AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, p.total, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.total AS part,
  -ln((CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / CASE WHEN size = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, 1 - abs((length(text) - size + 1) / CAST(size AS DOUBLE) - 5.5::DOUBLE) / 8) / CASE WHEN size < 5 THEN 2 ELSE 1 END END AS key
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, total AS source_size, target, CAST(epochs * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken FROM c""",
    "op6_hamming_search": """
WITH c AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS code FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
h AS (SELECT q.id AS query_id, c.id AS match_id, CAST(len(list_filter(range(1, 65), lambda i: q.code[i] <> c.code[i])) AS INTEGER) AS distance FROM c q JOIN c ON c.id <> q.id WHERE q.id % 100 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, match_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id) AS n FROM h) WHERE n <= 10""",
    "op11_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, 2 * length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')) AS shown, 2 * length(role) - length(regexp_replace(role, '[\\<\[]', '', 'g')) AS named FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(shown + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 17 ELSE 19 + named END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200""",
    "op13_vector_codes": _vector_codes(),
}
