"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark items, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs`` as they are. Classifiers are fitted on
the labelled documents among a stage's own input, never on held-out ones. Null texts are empty texts; rows with a null
doc_id or without words pass the near-duplicate stage (they copy nothing); rows that repeat a doc_id are judged there by
their texts. A stage bounds the Arrow batches of its session (``common.bound_batches``): executors keep their workers and
their native memory over all stages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harvestry.llm import bpe, decontaminate, neardup, quality, toxicity
from harvestry.llm.common import Workspace, bound_batches, table


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.5)


@_bounded
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.3)


@_bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id."""
    return neardup.keep_one(docs)


@_bounded
def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every remaining document's token ids and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.RANKS_FILE), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_test_items),
    ("byte_bpe", encode),
]

#: No stage but the last could be put into SQL, and that one not by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
