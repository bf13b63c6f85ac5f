"""A training corpus from `documents`: filter, deduplicate, decontaminate, redact, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import byte_bpe, decontaminate, near, pii, quality
from tickloom.llm.common import MADE, removed, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; cases: `quality.keep_good`."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; cases: `near.one_of_each`."""
    return near.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go; cases: `decontaminate.without_benchmark`."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in the texts; n_chars follows; cases: `pii.redact_pii`."""
    return pii.redact_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: counts and digests of ids and of the decoded bytes; cases: `byte_bpe.round_trip`."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the learned spans nor the merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet to the shared folder and read again, and what a stage
    wrote on its way is removed when its result stands.

    Defined cases: every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables
    and columns of any other name, as its operator's docstring says; a null or empty text is rejected by the first.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(MADE)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            removed(spark, [p for p in MADE[before:] if p != path])
    return docs
