"""From raw documents to token ids: quality rules, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Defined cases are those of the operators; besides, rows that repeat
in doc_id and text are one document, and a text whose words are all removed stays as a row without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import bpe, decontaminate, jaccard_join, line_crf, shared, substring_dedup


def measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    field = line_crf.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.keep(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id."""
    own = F.struct(F.col("doc_id"), F.xxhash64("text").alias("digest"))
    groups = jaccard_join.join(docs.select(own.alias("own"), "text"), key="own")
    first = groups.filter("own = component_id").select("own").distinct()
    rows = docs.select(own.alias("own"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    kept = rows.join(first.withColumnRenamed("own", "first"), F.col("own").eqNullSafe(F.col("first"))).dropDuplicates(["own"])
    return kept.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier."""
    return measured(substring_dedup.remove(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    paths = decontaminate.prepare(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return measured(decontaminate.remove(docs, paths))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and, decoded from them, the text as bytes."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: No stage but the removal of benchmark passages could be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
