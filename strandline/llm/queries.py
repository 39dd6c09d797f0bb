"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.chat import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.token_files import token_files

    return token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.unigram import encoding_digest, load_unigram

    return encoding_digest(read_table(spark, sf_dir, "documents"), load_unigram(tokenizer_path("piece_bpe_32k.model")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.substring import repeated_passages

    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.mixing import mixing_plan

    return mixing_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality_model import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.media import media_digest, stored_media

    return media_digest(stored_media(read_table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.simhash import simhash_components

    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.sharding import shard

    return shard(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.lexical import ranked_search

    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.resampling import importance_resampling

    return importance_resampling(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.vector_links import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_token_files, op3_sentencepiece, op4_quality_rules, op5_substring_dedup, op6_mixing, op7_quality_classifier, op8_media_columns, op9_simhash, op10_sharding, op11_lexical_search, op12_importance_resampling, op13_vector_links)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from strandline.llm import chat, lexical, mixing, quality_rules, resampling, vector_links

    return {"op1_chat_formatting": chat.ORACLE_SQL, "op4_quality_rules": quality_rules.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op12_importance_resampling": resampling.ORACLE_SQL, "op13_vector_links": vector_links.ORACLE_SQL}
