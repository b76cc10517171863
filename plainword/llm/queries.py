"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc_dedup, chat_format, decontam, mixing, quality_model, quality_rules, secret_scan, shard_minimax, simhash_vp, url_graph
from .common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"))


def op3_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge_urls(load(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vp.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vp.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_dedup.repeated_spans(load(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_minimax.minimax_shards(load(spark, sf_dir, "documents"))


def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    both = rows.unionByName(more)
    records = both.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    turns = chat_format.canonical(records, "conv_id", "turn", "record")
    return chat_format.chat_digest(chat_format.read_back(chat_format.format_chats(turns)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(load(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_quality_rules, op3_url_graph, op4_quality_classifier, op5_mix_sources, op6_simhash, op7_substrings, op8_shards, op9_chats, op10_secrets)
}

_RULES_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, t, w, l, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND NOT 10 * n_symbols > n_words
  AND NOT (word_chars < 3 * n_words OR word_chars > 12 * n_words)
  AND NOT 10 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > 3 * length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
  AND NOT 10 * length(regexp_replace(t, '[^0-9]+', '', 'g')) > 2 * word_chars
  AND NOT 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 8 * n_words
  AND NOT (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * len(l))
  AND NOT 10 * len(list_distinct(w)) < n_words AS kept
FROM b
"""

_CHATS_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (SELECT *, replace(replace(role, '&', '&amp;'), '<', '&lt;') AS er, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS et FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(er) + length(et) + 20)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _RULES_SQL, "op9_chats": _CHATS_SQL}
