"""Queries over whole tables with production parameters, one per operator, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, exact_dedup, language_crf, line_dedup, logistic_mix, mixing, packing, piece_counts, simhash, syncmers
from tessella.session import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify_languages(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logistic_mix.score_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql(
        "select conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (-1L, 0L, 'user'), (-1L, 1L, 'assistant') as t(conv_id, turn, role)"
    )
    out = chat.format_chats(rows.unionByName(probe))
    turns = chat.read_turns(F.col("formatted"))
    read = out.select("conv_id", "formatted", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_syncmers": op5_syncmers,
        "op6_chat_format": op6_chat_format,
        "op7_packing": op7_packing,
        "op8_lm_scores": op8_lm_scores,
        "op9_line_dedup": op9_line_dedup,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op6_chat_format": r"""
            WITH rows AS (
                SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
            marked AS (
                SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|ROLE\]|SEP\]|INST\]))', '\1\\\2\3', 'g') AS shown,
                    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev
                FROM rows)
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                CAST(3 + sum(length(shown) + CASE WHEN prev IS NULL OR prev <> role THEN 13 + length(role) + 4 ELSE 5 END) AS BIGINT) AS formatted_chars
            FROM marked GROUP BY conv_id""",
        "op9_line_dedup": r"""
            WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
            lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM parts),
            keyed AS (
                SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
            owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
            judged AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS lost FROM keyed k LEFT JOIN owners o USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
            FROM judged GROUP BY doc_id""",
    }
