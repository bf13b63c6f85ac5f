"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, html, language, near, negatives, pii, spelling, sql, suffix, token_shards, warc
from .common import table
from .quality import quality_verdicts


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; imported late, as only these queries need the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digest(chat.with_control_strings(table(spark, sf_dir, "conversations")))


def op4_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_file_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("tk")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op11_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), dropped_of=199)


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), key % 100 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_semi_markov_pii": op1_semi_markov_pii,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_reply_trees": op3_reply_trees,
    "op4_repair_token_shards": op4_repair_token_shards,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_warc_transactions": op7_warc_transactions,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_hyperdimensional_language": op11_hyperdimensional_language,
    "op12_spelling_trie": op12_spelling_trie,
    "op13_kronecker_negatives": op13_kronecker_negatives,
}

SQL: dict[str, str] = {
    "op2_template_decontamination": sql.OP2,
    "op3_reply_trees": sql.OP3,
    "op5_quality_rules": sql.OP5,
    "op7_warc_transactions": sql.OP7,
    "op12_spelling_trie": sql.OP12,
    "op13_kronecker_negatives": sql.OP13,
}
