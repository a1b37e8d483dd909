"""The engine's relations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part (the source), doc and text of every document."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("doc"), "text", "lang")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc and status: toxic ones are drafts, ones of low quality superseded."""
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.max("toxic") == 1, "draft").when(F.min("quality") == 0, "superseded").otherwise("final")
    return labels.groupBy(F.col("doc_id").alias("doc")).agg(status.alias("status"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, part (null: every partition) and text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lit(None).cast("string").alias("part"), "text")


def benchmark_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query and doc: documents that hold the item's first sentence as a sentence of theirs."""
    sentence = lambda c: F.trim(F.col(c))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.split("text", r"\.").getItem(0).alias("sentence")).select("query", sentence("sentence").alias("sentence")).filter("sentence <> ''")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", r"[.\n]")).alias("sentence")).select("doc", sentence("sentence").alias("sentence"))
    return items.join(docs, "sentence").select("query", "doc").distinct()
