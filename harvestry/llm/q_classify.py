"""Queries that score documents by what labels mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .common import held_out_column, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), spans=False)
    return rows.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity, "op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
