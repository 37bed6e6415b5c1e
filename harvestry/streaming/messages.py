"""The row pipeline over unbounded messages, and runs that resume where they stopped.

Messages arrive as files (or any streaming source) with ``seq`` and ``raw``; decoding, matching and row splitting are
stateless, so a stream gives the rows that the batch gives. Only deduplication keeps state, and rows without a key go
past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import rows
from ..sources import embedded


def read_messages(spark: SparkSession, path: str, schema: str = "seq bigint, raw string", kind: str = "parquet") -> DataFrame:
    """A streaming table of captured messages."""
    return spark.readStream.schema(schema).format(kind).load(path)


def message_rows(frames: DataFrame, fields: dict, where: dict | None = None, items: str | None = None, binary: bool = False, length_bytes: int = 0, type_bytes: int = 0) -> DataFrame:
    """Rows of text or binary frames; works on static and streaming tables alike."""
    found = embedded.binary_frames(frames, length_bytes=length_bytes, type_bytes=type_bytes) if binary else embedded.text_frames(frames).withColumn("part", F.lit(0))
    if where:
        found = rows.message_matches(found, where)
    return rows.json_rows(found, fields, items, keep=("seq", "part"))


def drop_repeats(found: DataFrame, key: str) -> DataFrame:
    """One row a key over the whole stream; rows with an empty key all pass (a branch of their own)."""
    filled = values.non_empty(F.col(f"`{key}`"), found.schema[key].dataType)
    return found.where(filled).dropDuplicates([key]).union(found.where(~F.coalesce(filled, F.lit(False))))


def run(found: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None) -> int:
    """Appends all rows that are there now to JSON lines and stops; the checkpoint says where the next run begins.

    Returns the rows written by this run.
    """
    out = found.select(*[F.col(f"`{c}`") for c in columns]) if columns else found
    query = out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return sum(p["numInputRows"] for p in query.recentProgress)
