"""One query per operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm.chat import chat_digests, format_chats
from lacewing.llm.exact import exact_duplicates
from lacewing.llm.minhash import near_duplicates
from lacewing.llm.mixing import mix_sources, mixture_order
from lacewing.llm.packing import pack_documents
from lacewing.llm.quality import quality_rules
from lacewing.llm.sharding import shard_documents
from lacewing.llm.substring import remove_repeats
from lacewing.llm.token_files import read_token_files, write_token_files
from lacewing.llm.tokens import count_tokens
from lacewing.session import table_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chats(rows.unionByName(more)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole text."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal size."""
    placed = shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of each document, and of its host on it."""
    return quality_rules(_table(spark, sf_dir, "documents")).drop("source")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as ids in coded files, and each document as read back from them."""
    path = table_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_token_files(spark, path, ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without runs of 20 words that start earlier too."""
    return remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document and its seat in sequences of 1024 ids."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0, length=1024)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each document at temperature 0.7, and their places in the shuffle."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture_order(mix_sources(docs, temperature=0.7, seed=1))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each document against a new index."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_token_counts, op3_sharding, op4_quality_rules, op5_token_files, op6_substring_dedup, op7_packing, op8_mixing, op9_exact_dedup, op10_minhash_near_dedup)}


_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, lag(role, 1, 'start') OVER s AS before, lead(role) OVER s AS after FROM c WINDOW s AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?SYS\]|ROLE:|/ROLE\])'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + 2 * strlen(role) END)::BIGINT AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM n GROUP BY conv_id"""

#: The figures of the quality rules, and the verdicts.
_QUALITY = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
k AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) x(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words AS many_symbols,
  10 * n_dup_lines > 3 * n_lines AS many_repeated_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS odd_words FROM f),
u AS (SELECT source, unnest(['base_failed', 'many_symbols', 'many_repeated_lines', 'odd_words']) AS rule, unnest([base_failed, many_symbols, many_repeated_lines, odd_words])::INT AS broken FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(broken) AS bad, sum(broken) / count(*) AS rate FROM u GROUP BY source, rule),
p AS (SELECT rule, avg(rate) AS m, CASE WHEN var_samp(rate) > 0 THEN greatest(avg(rate) * (1 - avg(rate)) / var_samp(rate) - 1, 1) ELSE 1 END AS s FROM h GROUP BY rule),
q AS (SELECT source, rule, m, n + s + 1 AS n, (bad + m * s) / (n + s) AS rate FROM h JOIN p USING (rule)),
v AS (SELECT source, bool_or(rate - sqrt(rate * (1 - rate) / n) > 0.5) AS rejected, list(rule) FILTER (WHERE rate + sqrt(rate * (1 - rate) / n) < m) AS trusted FROM q GROUP BY source)"""
_QUALITY_VERDICTS = _QUALITY + """
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, many_symbols, many_repeated_lines, odd_words,
  NOT (base_failed OR rejected OR (many_symbols AND NOT coalesce(list_contains(trusted, 'many_symbols'), false))
    OR (many_repeated_lines AND NOT coalesce(list_contains(trusted, 'many_repeated_lines'), false)) OR (odd_words AND NOT coalesce(list_contains(trusted, 'odd_words'), false))) AS kept
FROM b JOIN v ON v.source IS NOT DISTINCT FROM b.source"""

_MIXING = r"""
WITH z AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
l AS (SELECT source, size ** 0.7 / (SELECT sum(size ** 0.7) FROM z) * (SELECT sum(size) FROM z) / size AS rate FROM z),
p AS (SELECT source, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l, range(200) t(k)),
d AS (SELECT doc_id, source, ('0x' || substr(md5('1:draw:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM d.source AND p.cdf <= d.u) AS copies FROM d),
c AS (SELECT doc_id, source, copies, unnest(range(copies)) AS copy FROM n)
SELECT doc_id, source, copy, copies, row_number() OVER (ORDER BY substr(md5('1:place:' || doc_id || ':' || copy), 1, 13), doc_id, copy) - 1 AS position FROM c"""

_EXACT = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op4_quality_rules": _QUALITY_VERDICTS, "op8_mixing": _MIXING, "op9_exact_dedup": _EXACT}
