"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())


def url_rules() -> list:
    from tidemark.llm.urls import Rule

    return [
        Rule("block", "com", "/en/"),
        Rule("allow", "example.com", "/en/7"),
        Rule("allow", "net", "/de/"),
        Rule("block", "example.net", "/de/8"),
        Rule("block", "org", "/es/"),
    ]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import urls

    return urls.judge(table(spark, sf_dir, "pages"), url_rules())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import mixing

    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import repair

    return repair.token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import chat

    return chat.rendered(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
      ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
  FROM turns GROUP BY conv_id),
heads AS (SELECT DISTINCT turns[1:k] AS head FROM convs, range(1, n_turns) AS r(k)),
firsts AS (SELECT turns, min(conv_id) AS conv_id FROM convs GROUP BY turns)
SELECT c.conv_id, c.n_turns, c.text FROM convs c JOIN firsts f ON c.conv_id = f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.head = c.turns)
"""


def op5_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import sharding

    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import substring

    return substring.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "at", "component_id", "removed")


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import media

    return media.media_columns(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_media_chunks": op2_media_chunks,
        "op3_chat_format": op3_chat_format,
        "op4_token_files": op4_token_files,
        "op5_hash_shards": op5_hash_shards,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_source_mix": op8_source_mix,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL}
