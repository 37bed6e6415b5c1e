"""The bounded sample of labelled documents that the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_column

#: Labelled documents that a classifier is fitted on, at most: those of the smallest hashed ids, so any order and any
#: partitioning of the tables gives the same sample. The statistics of what is scored are never sampled.
SAMPLE = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """text and y (0 or 1) of at most ``limit`` labelled documents that aren't held out.

    Null ids or labels are no examples; an id labelled twice counts with its larger label. The labels kept are at most
    ``limit`` small rows, so they are broadcast and no text is shuffled.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_column())
    few = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("text", "y")
