"""From raw documents to packed training sequences, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's documents.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.decontaminate import decontaminate
from hirelens.llm.line_dedup import dedup_lines
from hirelens.llm.packing import pack_instructions
from hirelens.llm.quality import keep_good
from hirelens.llm.shared import fresh_path, table
from hirelens.llm.simhash import drop_near_duplicates

#: Words that a worker remembers in a stage. It serves the stages one after the other, in an executor whose heap they
#: have filled, so it has less room than where one operator runs alone.
WORDS_HELD = 75_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their script's fertility bands."""
    return keep_good(docs, WORDS_HELD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars is that of what is left. Other columns, whatever their names,
    stay as they are."""
    used = ("doc_id", "text", "source")
    safe = docs.select(*(F.col(f"`{c}`").alias(c if c in used else f"__{i}") for i, c in enumerate(docs.columns)))
    left = dedup_lines(safe)
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c if c in used else f"__{i}").alias(c) for i, c in enumerate(docs.columns)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of `benchmark`."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack_instructions(docs, public_tokenizers.path("word_bpe_49k.json"), WORDS_HELD)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]
#: Tokenisers and connected components aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
