"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, line_dedup, mixing, near_dup, pii, quality, rules, sentence_piece, urls, vector_dup
from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word in DuckDB's regular expressions.
_SQL_WORD = r"[^\x20\x09-\x0D]+"


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_OP10_RULES = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, condition in enumerate(rules.RULES.values()))


@_query(
    "op10_quality_rules",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, unnest(regexp_extract_all(text, '{_SQL_WORD}')) AS word,
                 generate_subscripts(regexp_extract_all(text, '{_SQL_WORD}'), 1) AS i FROM d),
    five AS (SELECT rid, i, word, lag(word) OVER s AS before, count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS have,
                    concat_ws(' ', word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s) AS win
             FROM w WINDOW s AS (PARTITION BY rid ORDER BY i)),
    often AS (SELECT rid, i, word, before, CASE WHEN have = 5 AND count(*) OVER (PARTITION BY rid, win, have) >= 2 THEN 1 ELSE 0 END AS hit FROM five),
    cover AS (SELECT rid, word, before, max(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM often),
    by_word AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, sum(inside) AS n_repeat_words,
                       sum(CASE WHEN word LIKE '%!' THEN 1 ELSE 0 END) AS n_shouts, sum(CASE WHEN word = before THEN 1 ELSE 0 END) AS n_stutters
                FROM cover GROUP BY rid),
    l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
    by_line AS (SELECT rid, count(*) AS n_lines, count(line) FILTER (WHERE regexp_matches(line, '{_SQL_WORD}'))
                       - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '{_SQL_WORD}')) AS n_dup_lines FROM l GROUP BY rid),
    m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, n_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_shouts, 0) AS n_shouts, coalesce(n_stutters, 0) AS n_stutters,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
          FROM d LEFT JOIN by_word USING (rid) JOIN by_line USING (rid)),
    b AS (SELECT *, {_OP10_RULES} AS fail_bits FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(fail_bits AS BIGINT) AS fail_bits,
           fail_bits & {rules.mask("base-1")} <> 0 AS base_failed,
           fail_bits & {rules.mask("base-1") | rules.mask(rules.DEFAULT_POLICY)} = 0 AS kept
    FROM b
    """,
)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


@_query(
    "op4_mix_sources",
    rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}')) AS size,
                      md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
    s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
    w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(rank - 1) % 3 + 1] AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
                 3.0::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
    h AS (SELECT *, 2 * cap * sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 <= weight * (total - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held FROM w),
    t AS (SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN held THEN cap ELSE weight * (total - 2 * sum(CASE WHEN held THEN cap ELSE 0 END) OVER ())
                 / (2 * sum(CASE WHEN held THEN 0 ELSE weight END) OVER ()) END AS DOUBLE) AS target FROM h),
    f AS (SELECT *, CAST(floor(target) AS BIGINT) AS whole, CAST(3 * sum(source_size) OVER () // 2 - sum(CAST(floor(target) AS BIGINT)) OVER () AS BIGINT) AS left_over FROM t),
    x AS (SELECT source, whole, left_over, row_number() OVER (ORDER BY e / target, rank, e) AS place
          FROM f, unnest(range(whole + 1, least(whole + left_over, 2 * source_size) + 1)) AS u(e)),
    b AS (SELECT f.source, f.source_size, f.target, f.whole + count(x.place) AS budget FROM f LEFT JOIN x ON x.source IS NOT DISTINCT FROM f.source AND x.place <= x.left_over
          GROUP BY f.source, f.source_size, f.target, f.whole),
    q AS (SELECT doc_id, size, source_size, target, budget,
                 CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
          FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(greatest(0, least(size, budget - upto + size)) + greatest(0, least(size, budget - upto - source_size + size)) AS BIGINT) AS taken FROM q
    """,
)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


_OP8_RULES = " ".join(
    f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN '{host}{path}|{verdict}'"
    for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
)


@_query(
    "op8_url_filter",
    rf"""
    WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
                 CASE WHEN len(regexp_extract_all(coalesce(html, ''), '{urls.SIGN}')) >= {urls.SIGNS} THEN 1 ELSE 0 END AS junk FROM pages),
    h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, junk FROM p),
    l AS (SELECT host AS key FROM h WHERE host <> '' GROUP BY host HAVING {urls.JUNK_SHARE} * sum(junk) > count(*)),
    r AS (SELECT *, CASE {_OP8_RULES} END AS hit FROM h)
    SELECT page_id, host, path, split_part(hit, '|', 1) AS rule,
           CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN l ON l.key = r.host
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production list is a table made from the pages: hosts that serve filler."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.junk_hosts(pages))


@_query(
    "op9_minhash_near_dup",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_WORD}') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT DISTINCT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
    m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
    """,
)
def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(table(spark, sf_dir, "documents")).drop("t")


@_query("op6_quality_knn")
def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Where the public SentencePiece model of this machine lies; on a cluster, a path that every executor has.
TOKENIZER_DIR = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")


def sentencepiece_model() -> str:
    return os.path.join(TOKENIZER_DIR, "piece_bpe_32k.model")


@_query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.encode(table(spark, sf_dir, "documents"), sentencepiece_model(), carry=["doc_id"])


@_query(
    "op5_line_dedup",
    rf"""
    WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(list_transform(ls, lambda x: regexp_extract_all(x, '{_SQL_WORD}'))) AS w FROM d),
    o AS (SELECT doc_id, line_no, len(w) AS n, array_to_string(w, ' ') AS s, w FROM l WHERE len(w) >= {line_dedup.MIN_WORDS}),
    c AS (SELECT s, any_value(n) AS n, any_value(w) AS w, min((doc_id, line_no)) AS place FROM o GROUP BY s),
    v AS (SELECT s, n, place, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v
          FROM c, unnest(range(1, len(w) + 1)) AS u(i) WHERE n >= {line_dedup.NEAR_WORDS}),
    g AS (SELECT s, place, min(place) OVER (PARTITION BY v, i, n) AS head FROM v),
    near AS (SELECT s FROM g WHERE head < place
             UNION SELECT CASE WHEN v.place > c.place THEN v.s ELSE c.s END FROM v JOIN c ON v.v = c.s AND c.n >= {line_dedup.NEAR_WORDS}),
    gone AS (SELECT o.doc_id, list(o.line_no) AS removed FROM o JOIN c USING (s) LEFT JOIN near ON near.s = o.s
             WHERE near.s IS NOT NULL OR c.place <> (o.doc_id, o.line_no) GROUP BY o.doc_id)
    SELECT d.doc_id, CASE WHEN gone.removed IS NULL THEN text ELSE
             array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone.removed, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
           CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone.removed), 0) AS BIGINT) AS n_removed
    FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query(
    "op3_vector_near_dup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
    r AS (SELECT DISTINCT x AS vec_id, x AS root FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
    m AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id),
    n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
    SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.root, v.vec_id) AS component_id, coalesce(m.root, v.vec_id) = v.vec_id AS kept
    FROM v LEFT JOIN n ON n.vec_id = v.vec_id LEFT JOIN m ON m.vec_id = v.vec_id
    """,
)
def op3_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.linked(table(spark, sf_dir, "embeddings"))


@_query("op1_pii_sanitise")
def op1_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


#: Production schemas of the tools that conversations may call.
TOOL_SCHEMAS: chat.Schemas = {
    "search": {"properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"properties": {"url": {"type": "string"}, "timeout": {"type": "number"}}, "required": ["url"]},
}


@_query(
    "op7_chat_format",
    """
    WITH m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    j AS (SELECT *, CAST(turn // 512 AS BIGINT) AS part, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS line FROM m),
    i AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, line) - 1) // 512 AS BIGINT) AS piece FROM j)
    SELECT conv_id, part, piece, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
           '{"conv_id":' || conv_id || ',"messages":[' || string_agg(line, ',' ORDER BY turn, role, line) || ']}' AS json
    FROM i GROUP BY conv_id, part, piece
    """,
)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"), TOOL_SCHEMAS)
