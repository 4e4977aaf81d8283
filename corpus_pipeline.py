"""The corpus pipeline: quality rules, near-duplicates, repeated bytes, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkseam.llm import decontaminate, minhash, quality_rules, sentencepiece_merge, suffix_dedup
from inkseam.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs, width=5, percent=80)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 200-byte strings that stand elsewhere too; documents that lose all their text go."""
    return suffix_dedup.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that consist mostly of passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    import public_tokenizers

    out = sentencepiece_merge.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.selectExpr("doc_id", "lang", "source", "sp_n_tokens AS n_tokens", "sp_ids AS ids", "sp_ids_sha256 AS ids_sha256", "sp_decoded_sha256 AS decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_bytes),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the suffix arrays nor the tokenizer. Tests hold the operators against brute force, but not run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
