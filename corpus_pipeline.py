"""Corpus pipeline: from raw documents to a mixture of clean, distinct ones.

Each stage reads what its predecessor kept, after letting go of that one's shuffles and broadcasts.  Language identification drops texts without an
identifiable language; line dedup cuts repeated lines; near-dedup keeps the smallest
doc_id of each group; decontamination drops documents beyond the coverage limit and
cuts hit spans out of others; mixing says how many words of each document to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontaminate, language_id, line_dedup, mixing, shingle_dedup
from larder.llm.storage import cut, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return line_dedup.remove_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Similarity 0.8 of five-word shingles: candidates by SimHash and by MinHash, then the exact check."""
    release(spark)
    return shingle_dedup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes: their cleaned texts, sizes, targets and taken words."""
    release(spark)
    mixed = mixing.mix(docs, carry=("text",))
    return mixed.where("taken > 0").select("doc_id", "text", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Cross-parsing, SimHash and edit similarity have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
