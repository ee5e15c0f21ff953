"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_fst, chat_format, fingerprints, language_id, ngram_join, packing, quality_pu, quality_rules, suffix_dedup, token_binary
from .common import table

_PATTERN, _path = public_tokenizers.PATTERN, public_tokenizers.path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "n_lost_words"
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"), percent=90, width=3)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_binary.round_trip(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", "n_copies", F.length("chat").cast("long").alias("n_chars"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.id_hash(F.col("doc_id")) % 4 == 2
    model = language_id.fit(docs.where(~held_out), _path("piece_bpe_32k.model"))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.id_hash(F.col("doc_id")) % 5 == 0
    model = quality_pu.fit(docs.where(~held_out), labels.where(~held_out))
    scored = quality_pu.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_pu.THRESHOLD).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_fst.encode_decode(table(spark, sf_dir, "documents"), _path("byte_bpe_multi_50k.tiktoken"), _PATTERN)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard, op3_token_files, op4_chat_format, op5_fingerprints,
        op6_language_id, op7_suffix_dedup, op8_quality_pu, op9_packing, op10_byte_bpe,
    )
}

_W = r"[\x20\x09-\x0D]"
_N = r"[^\x20\x09-\x0D]"

ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), line AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '{_N}+')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_N}')
), judged AS (
  SELECT doc_id, l, n,
    len(regexp_extract_all(l, '{quality_rules.NOISE}')) * 10 >= n * {quality_rules.NOISE_PER_10_WORDS}
    OR len(regexp_extract_all(l, '{quality_rules.SEPARATOR}')) >= {quality_rules.MIN_SEPARATORS}
    OR (n >= {quality_rules.PLAIN_LINE_WORDS} AND NOT regexp_matches(l, '{quality_rules.SENTENCE}'))
    OR (n <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(lower(l), '{quality_rules.BOILERPLATE}')) AS fails
  FROM line
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
         count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words
  FROM judged GROUP BY doc_id
), all_counts AS (
  SELECT d.doc_id, len(ws) AS n_words,
    length(text) - len(regexp_extract_all(text, '{_W}')) AS word_chars,
    len(regexp_extract_all(text, '{quality_rules.SYMBOLS}')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND n_lost_words * 100 <= n_words * 50 AS kept,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, n_lost_words::BIGINT AS n_lost_words
FROM all_counts
""",
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT a, b FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.r, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
""",
    "op4_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list(role || chr(0) || text ORDER BY turn, role, text) AS said,
    string_agg('{chat_format.TURN_START}' || role || chr(10) || text || '{chat_format.TURN_END}' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM t GROUP BY conv_id
), whole AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, said, min(chat) AS chat FROM c GROUP BY n, said)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, length(chat)::BIGINT AS n_chars, sha256(chat) AS chat_sha256
FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.said[1] = a.said[1] AND b.n > a.n AND b.said[1:a.n] = a.said)
""",
}
