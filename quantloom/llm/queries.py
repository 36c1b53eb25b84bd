"""The corpus queries opN_<name> and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, table
from .conversation_repair import repair_digest
from .decontam import contamination_digest
from .embedding_dedup import embedding_links
from .html_extract import main_text
from .language_id import language_digest
from .line_dedup import line_digest
from .oracle import ORACLE_SQL
from .prefix_trie import trie_digest
from .secret_scan import secret_digest
from .sentencepiece import piece_digest
from .simhash import simhash_digest
from .suffix_dedup import substring_digest
from .token_counts import token_counts
from .token_output import token_orc_query


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(spark, table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"), Scratch(spark, "suffix"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc_query(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), Scratch(spark, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"), Scratch(spark, "lines"), runs=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"), Scratch(spark, "repair"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_digest(table(spark, sf_dir, "conversations"), Scratch(spark, "trie"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_output": op4_token_output,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]
