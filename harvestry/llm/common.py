"""Shared plumbing: table access, durable intermediate tables, bounded text batches and word ids."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a Python worker; bounds its memory whatever the Arrow batch holds.
SUB_BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all executors are in the driver's
    process (a local master: tests) may it be unset; a temporary folder serves then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='harvestry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Lets Spark send Python workers Arrow batches of SUB_BATCH_CHARS bytes at most (one row at least), instead of up to
    10,000 rows or 64 MB, of which a worker holds two and the JVM one that it grows by doubling. Plans run after they are
    returned, so this stays set in the session; a smaller bound that is set already is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < held <= SUB_BATCH_CHARS:
        spark.conf.set(name, SUB_BATCH_CHARS)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def below(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts lie below a value (0 for null). A search in two steps, so that a row costs about two
    square roots of the cuts' number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda c: c < value))
    fine = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(coarse, F.lit(1))), lambda c: c < value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


class Workspace:
    """Written intermediate tables of one query, in the shared folder, so that lost executors lose no lineage.

    ``write`` cuts lineage by a Parquet table. ``drop`` removes tables that no later plan reads; what the returned
    DataFrame still reads goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._cleanup)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._written)

    def _cleanup(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def sub_batches(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each (one row at least)."""
    limit = limit or SUB_BATCH_CHARS
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str | None = "text") -> DataFrame:
    """``mapInArrow`` over bounded slices; ``make`` builds the per-task function (once a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for part in sub_batches(batch, text) if text else [batch]:
                    if part.num_rows and (out := work(part)) is not None:
                        yield out
                    release()
        finally:
            release(getattr(work, "caches", ()))

    return df.mapInArrow(run, schema)


def release(caches=()) -> None:
    """Gives a task's memory back before the worker process takes the next task: workers live as long as the executor,
    and what their allocators keep would add up over the operators of a pipeline."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(column: pa.Array) -> list[str]:
    """Values as strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def words(text: str) -> list[bytes]:
    r"""Lower-cased (A-Z only) words ``[^\x20\x09-\x0D]+`` of a text, as UTF-8: exactly what bytes.split() cuts."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of a batch of texts (null: empty): each row's bounds, every word's index, the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    found = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    index, distinct = found.indices.to_numpy(), found.dictionary.cast(pa.binary()).to_pylist()
    if b"" in distinct:  # white space at a text's ends
        keep = index != distinct.index(b"")
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        index = index[keep]
    return bounds, index, distinct


def batch_word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bounds and a 64-bit hash of every word."""
    bounds, index, distinct = batch_words(column)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return bounds, ids[index] if len(index) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SHINGLE = 5


def shingle_hashes(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each run of k words; a shorter non-empty sequence is one shingle as a whole."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - width + 1 + j])
    return out


def batch_shingles(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The shingle hashes of each text (not distinct), computed over the whole batch at once."""
    bounds, ids = batch_word_ids(column)
    run = shingle_hashes(ids, k) if len(ids) >= k else np.empty(0, np.uint64)
    ends = bounds.tolist()
    return [run[a : b - k + 1] if b - a >= k else shingle_hashes(ids[a:b], k) for a, b in zip(ends, ends[1:])]  # noqa: B905


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is a multiple of 5: never learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: str = "doc_id"):
    """The same as a Spark column."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
