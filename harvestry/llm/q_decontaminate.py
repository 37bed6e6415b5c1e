"""Query over contaminated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate
from .common import table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, by pair."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
