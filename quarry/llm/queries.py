"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chat import chat_digest, format_chat
from quarry.llm.codebooks import vector_codes
from quarry.llm.decontaminate import contamination
from quarry.llm.exact_copies import exact_copies
from quarry.llm.near_copies import near_copies
from quarry.llm.neighbours import nearest_neighbours
from quarry.llm.packing import encode_stream, packed_pieces
from quarry.llm.pages import extract_main_text
from quarry.llm.prefix_trie import prefix_trie, rebuilt_conversations
from quarry.llm.quality import score_quality
from quarry.llm.token_counts import Automaton, byte_vocabulary, count_tokens
from quarry.llm.token_files import read_token_files, write_token_files
from quarry.llm.urls import BLOCKED_WORDS, filter_urls, host_rule
from quarry.session import fresh_path, ship_package


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = byte_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(table(spark, sf, "documents"), Automaton(vocabulary), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    stream = encode_stream(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed_pieces(stream, length=2048)


# The rules that the query judges by.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages"), [host_rule(*rule) for rule in RULES])


OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)}),
fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(lower(s.host || chr(10) || s.path),
         '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
"""


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts are control strings of a template.
    planted = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text"
        " FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return chat_digest(format_chat(turns.unionByName(planted)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on,
         regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE WHEN goes_on THEN 8 ELSE 16 + length(role) + 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _sql_words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP5_SQL = f"""
WITH items AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
places AS (
  SELECT doc_id, size, j, array_to_string(w[j:j + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, j, size FROM places JOIN windows USING (size, phrase)),
hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(j, j + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_main_text(table(spark, sf, "pages"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.3)


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies(table(spark, sf, "documents"), words=4, percent=80)


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^ 	-
]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[j:j + 3], ' ') || (CASE WHEN len(w) < 4 THEN ' ' ELSE '' END) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS j FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reached r USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
"""


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_copies(table(spark, sf, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(table(spark, sf, "documents"), path, tokenizer, end_id=2))


def op11_nearest(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return nearest_neighbours(embeddings, F.col("vec_id") % 100 == 0, k=10, probes=32)


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(rebuilt_conversations(table(spark, sf, "conversations"), keep=9, family=5), shard_depth=2)


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes(table(spark, sf, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


_OP13_PARTS = """
  SELECT vec_id, label, p, list_transform(range(w), lambda j: v[p * w + j + 1]) AS x
  FROM kept, (SELECT len(v) // 16 AS w FROM kept LIMIT 1), range(16) t(p)"""


def _op13_round(book: str, number: int) -> str:
    return f"""
assign{number} AS (
  SELECT vec_id, label, p, x, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT q.*, c.e,
               list_sum(list_transform(range(len(q.x)), lambda j: (q.x[j + 1] - c.x[j + 1]) * (q.x[j + 1] - c.x[j + 1]))) AS d
        FROM parts q JOIN {book} c USING (p))
  GROUP BY vec_id, label, p, x),
sums{number} AS (
  SELECT p, e, j, sum(xj) AS s, count(*) AS n
  FROM (SELECT p, e, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS xj FROM assign{number}) GROUP BY p, e, j),
book{number} AS (
  SELECT p, e, list(coalesce(floor(s / n)::BIGINT, old) ORDER BY j) AS x
  FROM (SELECT p, e, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS old FROM {book})
       LEFT JOIN sums{number} USING (p, e, j)
  GROUP BY p, e)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
parts AS ({_OP13_PARTS}),
book0 AS (
  SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
                                  FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_op13_round("book0", 1)},
{_op13_round("book1", 2)},
{_op13_round("book2", 3)},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM assign3 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS h
  FROM (SELECT p, e, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM book2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded, digest
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_decontamination": op5_decontamination,
    "op6_main_text": op6_main_text,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
    "op11_nearest": op11_nearest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op8_near_dedup": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op13_vector_codes": OP13_SQL,
}
