"""The training-data queries and the SQL that some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_decontamination, chat_formatting, curriculum_mixing, hard_negatives, line_dedup, lm_scoring, merkle_manifest, minhash_near_dedup, quality_classifier, quality_rules, suffix_array_dedup, token_counts, token_output
from .common import WORD, Shared, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_formatting.op1_chat_formatting,
    "op2_suffix_array_dedup": suffix_array_dedup.op2_suffix_array_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_benchmark_decontamination": benchmark_decontamination.op6_benchmark_decontamination,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_curriculum_mixing": curriculum_mixing.op8_curriculum_mixing,
    "op9_minhash_near_dedup": minhash_near_dedup.op9_minhash_near_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_token_output": token_output.op13_token_output,
}


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and hard rules of op3 alone: what SQL can state of it."""
    out = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), quality_rules.Field())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def length_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram and suffix sums of op10 over lengths that SQL can count: words."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")
    sums = token_counts.suffix_sums(Shared(spark).save(token_counts.histogram(read(spark, sf_dir, "documents").select(words)), "histogram"))
    return sums.withColumn("quantile", F.round("quantile", 9))


QUERIES |= {"quality_base": quality_base, "length_sums": length_sums}
ORACLES: dict[str, str] = {
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, u.i AS pos, w[u.i : u.i + 2] AS win FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 2),
again AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows), unnest([0, 1, 2]) AS t(k) WHERE times > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
""",
    "length_sums": r"""
WITH l AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS x FROM documents), h AS (SELECT x, count(*) AS n FROM l GROUP BY x),
s AS (SELECT x, n, sum(n) OVER above AS docs_from, sum(x * n) OVER above AS tokens_from, sum(n) OVER (ORDER BY x) AS up_to, sum(n) OVER () AS docs, sum(x * n) OVER () AS tokens FROM h WINDOW above AS (ORDER BY x DESC))
SELECT CAST(x AS BIGINT) AS n_tokens, n AS n_docs, CAST(docs_from AS BIGINT) AS docs_from, CAST(tokens_from AS BIGINT) AS tokens_from, CAST(up_to AS BIGINT) AS docs_up_to, round(up_to / docs, 9) AS quantile, CAST(tokens - tokens_from + docs_from * x AS BIGINT) AS truncated_tokens, CAST(tokens AS BIGINT) AS total_tokens FROM s
""",
    "op1_chat_formatting": chat_formatting.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_benchmark_decontamination": benchmark_decontamination.ORACLE,
    "op8_curriculum_mixing": curriculum_mixing.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
}
