"""Exact top-k search by vector-approximation files.

Components become integers floor(64 * x). Vectors are written in blocks: a byte for each component names its cell (the
block's range of that dimension in 2**CELL_BITS equal cells), the exact integers lie in a column of their own.

1. Each block of queries meets each block of cells, never of exact vectors: the centre product plus and minus the cells'
   half widths weighted by the query bounds every inner product. A task reads the cells from their files for some blocks
   of queries, and keeps for each query the vectors whose upper bound reaches the k-th best lower bound so far.
   Of equal vectors a block holds only those that can be among the k best, so a vector that a third of all rows share
   costs k + 1 candidates a block and query, not as many as it has rows.
2. The k-th best lower bound over all tasks is the query's floor; vectors whose upper bound lies below it go.
3. Exact vectors are read in the order of their bounds: the first k of each query, whose k-th score is then certain to
   be reached, and after them only those whose upper bound reaches that score. What is left out can't be in the result.

Scores are exact integers: where integers or products could leave 2**53, they are multiplied as Python integers. Scores
beyond a long are given as the nearest long. Ties go to the smaller vec_id. Null vectors, and those holding null or
non-finite components (or ones whose 64-fold isn't finite), take no part, nor do null ids; vectors of another length than
the query are no candidates. Repeated ids are repeated candidates; each row of a repeated query id is a query with a list
of its own; no row with a query's id is its candidate. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

SCALE = 64
CELL_BITS = 8
K = 20
BLOCK_ROWS = 8192
QUERY_ROWS = 512
GROUP = 16  # blocks of queries that read the cells together
HELD = 1_000_000  # candidates that a task holds
SAFE = 1 << 53
LONGEST = (1 << 63) - 1

BLOCK = "block bigint, dim int, n int, ids binary, exact binary, low binary, width binary, cells binary"


def _usable(df: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(~bad)


def _few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places (ids are sorted) without the copies of a vector that no k best can hold: as ties go to smaller ids, those of
    its first k + 1 ids stand for all (one may be a query's own), each with k rows at most."""
    group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    held: dict[int, dict[int, int]] = {}
    out = []
    for at, (g, i) in enumerate(zip(group.tolist(), ids.tolist(), strict=True)):
        own = held.setdefault(g, {})
        if own.get(i, 0) < k and (i in own or len(own) <= k):
            own[i] = own.get(i, 0) + 1
            out.append(at)
    return np.array(out, np.int64)


def _blocks(df: DataFrame, rows: int, count: int, k: int | None = None) -> DataFrame:
    """The vectors as blocks of at most ``rows`` vectors of one length, dealt to ``count`` partitions by id. With k, of
    equal vectors in a block only those that a k best can hold."""
    dealt = df.repartition(count, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = zip(*held.pop(dim), strict=True)
            made += 1
            return _pack(ids, np.array(vectors, float).reshape(len(ids), dim), (TaskContext.get().partitionId() << 32) + made, k)

        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == rows:
                    yield block(len(v))
        for dim in sorted(held):
            yield block(dim)

    return dealt.mapInArrow(run, BLOCK)


def _pack(ids: tuple, x: np.ndarray, number: int, k: int | None) -> pa.RecordBatch:
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    ids, scaled = np.array(ids, np.int64)[order], np.floor(x[order] * SCALE)
    if k is not None:
        some = _few_copies(ids, scaled, k)
        ids, scaled = ids[some], scaled[some]
    low = scaled.min(0) if scaled.size else np.zeros(x.shape[1])
    high = scaled.max(0) if scaled.size else low
    width = np.maximum((high - low) / (1 << CELL_BITS), 1e-300)
    cells = np.minimum(((scaled - low) / width).astype(np.int64), (1 << CELL_BITS) - 1).astype(np.uint8)
    values = (number, x.shape[1], len(ids), ids.tobytes(), scaled.tobytes(), low.tobytes(), width.tobytes(), cells.tobytes())
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "dim", "n", "ids", "exact", "low", "width", "cells"])


def _products(a: np.ndarray, b: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of the rows of two matrices, one a row, as longs."""
    if not len(a) or float((np.abs(a) * np.abs(b)).sum(1).max()) < SAFE:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = (sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    return [max(-LONGEST - 1, min(LONGEST, v)) for v in exact]


def _stored(paths: list[str], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, ids, cells' centres and widths of the blocks of one vector length, read block by block from their files."""
    for path in paths:
        where, name = fs.FileSystem.from_uri(path)
        with where.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(1, columns=["block", "dim", "ids", "low", "width", "cells"]):
                block, wide, ids, low, width, cells = (batch[c][0].as_py() for c in ("block", "dim", "ids", "low", "width", "cells"))
                if wide == dim:
                    ids, low, width = np.frombuffer(ids, np.int64), np.frombuffer(low, float), np.frombuffer(width, float)
                    yield block, ids, low + (np.frombuffer(cells, np.uint8).reshape(len(ids), dim) + 0.5) * width, width


def _near(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, centre: np.ndarray, width: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
    """Query, row, lower and upper bound of the vectors of a block that may be among a query's k best. ``best`` holds the
    k highest lower bounds of each query so far, the least of them first, and is brought up to date."""
    k = best.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = queries @ centre.T
        # half a cell each way, and room for rounding of the sums
        spare = np.abs(queries) @ (width / 2) + 1e-9 * (np.abs(queries) @ np.abs(centre).max(0, initial=0) + 1)
        vague = ~(np.isfinite(spare) & np.isfinite(middle.sum(1)))  # bounds beyond a double's range tell nothing
    first, last = np.searchsorted(ids, qids), np.searchsorted(ids, qids, "right")
    own = [(j, slice(first[j], last[j])) for j in np.flatnonzero(last > first).tolist()]
    middle[vague], spare[vague] = 0.0, np.inf
    for at in own:
        middle[at] = -np.inf
    floor = best[:, 0].copy()
    if len(ids) > k and (new := np.flatnonzero((floor == -np.inf) & ~vague)).size:  # the block's own k best serve then
        floor[new] = np.partition(middle[new], len(ids) - k, axis=1)[:, len(ids) - k] - spare[new]
    hit = middle >= np.where(vague, -np.inf, floor - spare)[:, None]
    for at in own:
        hit[at] = False
    j, row = np.nonzero(hit)
    near, room = middle[j, row], spare[j]
    lower = near - room
    if len(j):
        order = np.lexsort((-lower, j))
        some, begin = np.unique(j, return_index=True)
        place = np.arange(len(j)) - np.repeat(begin, np.diff(np.append(begin, len(j))))
        order, place = order[place < k], place[place < k]
        more = np.full((len(some), k), -np.inf)
        more[np.searchsorted(some, j[order]), place] = lower[order]
        best[some] = np.partition(np.concatenate((best[some], more), axis=1), k, axis=1)[:, k:]
    return j, row, lower, near + room


def _bounds(blocks: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """q_block, q_row, block, row, lower, upper: what is left of each query and vector block by their cells.

    A task holds up to GROUP blocks of queries and reads the cells from the blocks' files, one block at a time, so that
    neither is multiplied in a shuffle or sent by the driver. What it found falls away as the queries' floors rise. Where
    there are fewer blocks of queries than tasks, each is given to several tasks with a part of the files.
    """
    paths = sorted(blocks.inputFiles())
    count = asked.count()
    slices = max(1, min(len(paths), parts // max(1, count)))
    tasks = max(1, min(parts, count * slices), -(-count // GROUP))
    named = asked.select(F.col("block").alias("q_block"), F.col("dim"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    names = ["q_block", "q_row", "block", "row", "lower", "upper"]

    def search(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        dim = rows[0]["dim"]
        qids = [np.frombuffer(r["q_ids"], np.int64) for r in rows]
        queries = [np.frombuffer(r["q_exact"], float).reshape(len(i), dim) for r, i in zip(rows, qids, strict=True)]
        best = [np.full((len(i), k), -np.inf) for i in qids]
        held: list[list[tuple]] = [[] for _ in rows]
        n = 0

        def kept(at: int) -> tuple:
            block, j, row, lower, upper = (np.concatenate(x) for x in zip(*held[at], strict=True))
            some = upper >= best[at][j, 0]
            return block[some], j[some], row[some], lower[some], upper[some]

        def out() -> Iterator[pa.RecordBatch]:
            for at, r in enumerate(rows):
                if held[at]:
                    block, j, row, lower, upper = kept(at)
                    columns = (np.full(len(j), r["q_block"]), j, block, row, lower, upper)
                    held[at] = []
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

        for block, ids, centre, width in _stored(paths[rows[0]["slice"] :: slices], dim):
            for at in range(len(rows)):
                j, row, lower, upper = _near(qids[at], queries[at], ids, centre, width, best[at])
                if len(j):
                    held[at].append((np.full(len(j), block), j.astype(np.int32), row.astype(np.int32), lower, upper))
                    n += len(j)
                if n > HELD:
                    held = [[kept(x)] if held[x] else [] for x in range(len(rows))]
                    n = sum(len(x[0][0]) for x in held if x)
                    if 2 * n > HELD:
                        yield from out()
                        n = 0
        yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list[dict]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                group = groups.setdefault((row["dim"], row["slice"]), [])
                group.append(row)
                if len(group) == GROUP:
                    yield from search(groups.pop((row["dim"], row["slice"])))
        for key in sorted(groups):
            yield from search(groups.pop(key))

    return named.repartition(tasks, "q_block", "slice").mapInArrow(run, "q_block bigint, q_row int, block bigint, row int, lower double, upper double")


def _vectors(blocks: DataFrame, prefix: str = "") -> DataFrame:
    """block, row, id and vector (the integers as doubles) of every vector of the blocks."""
    names = [f"{prefix}{c}" for c in ("block", "row", "id", "vector")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, n, ids, exact = (batch[c][at].as_py() for c in ("block", "n", "ids", "exact"))
                wide = len(exact) // max(n, 1)
                vectors = [exact[j * wide : (j + 1) * wide] for j in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(np.frombuffer(ids, np.int64)), pa.array(vectors, pa.binary())], names)

    return blocks.select("block", "n", "ids", "exact").mapInArrow(run, f"{names[0]} bigint, {names[1]} int, {names[2]} bigint, {names[3]} binary")


def _scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """q_block, q_row, query_id, vec_id and the exact score of pairs (q_block, q_row, block, row)."""
    both = pairs.select("q_block", "q_row", "block", "row").join(vectors.hint("merge"), ["block", "row"]).join(queries.hint("merge"), ["q_block", "q_row"])
    names = ["q_block", "q_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["q_vector"].to_pylist(), batch["vector"].to_pylist()
            scores: list = [0] * len(a)
            for size in set(map(len, a)):
                at = [j for j, x in enumerate(a) if len(x) == size]
                x, y = (np.frombuffer(b"".join(v[j] for j in at), float).reshape(len(at), size // 8) for v in (a, b))
                for j, v in zip(at, _products(x, y), strict=True):
                    scores[j] = int(v)
            yield pa.RecordBatch.from_arrays([batch["q_block"], batch["q_row"], batch["q_id"], batch["id"], pa.array(scores, pa.int64())], names)

    return both.select("q_block", "q_row", "q_id", "q_vector", "id", "vector").mapInArrow(run, "q_block bigint, q_row int, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among the other vectors.

    Every GROUP blocks of queries read all cells, an eighth of the vectors, from the shared folder; exact vectors are moved
    once for each of the two reads, whatever the number of queries. No join broadcasts: Spark judges a table by its
    compressed files, and what it takes for a small one may be many times as large on the driver.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "vafile")
    usable = _usable(vectors)
    parts = max(1, -(-usable.count() // BLOCK_ROWS))
    blocks = work.write(_blocks(usable, BLOCK_ROWS, parts, k), "blocks")
    asked = work.write(_blocks(_usable(queries), QUERY_ROWS, max(1, parts // 8)), "queries")
    key = ["q_block", "q_row"]
    of_query = Window.partitionBy(*key)
    left = work.write(_bounds(blocks, asked, k, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "bounds")

    def kth(rows: DataFrame, value: str, order) -> DataFrame:
        """Each query's k-th best value as its floor; none where there are fewer."""
        best = rows.withColumn("place", F.row_number().over(of_query.orderBy(*order))).where(F.col("place") <= k)
        return best.groupBy(*key).agg(F.when(F.count("*") == k, F.min(value)).otherwise(float("-inf")).alias("floor"))

    floors = kth(left.select(*key, "lower"), "lower", [F.desc("lower")])
    ordered = of_query.orderBy(F.desc("upper"), "block", "row")
    some = left.join(floors.hint("merge"), key).where(F.col("upper") >= F.col("floor")).drop("floor")
    some = work.write(some.withColumn("place", F.row_number().over(ordered)), "candidates")
    work.drop(left)
    exact, wanted = _vectors(blocks), _vectors(asked, "q_")
    first = work.write(_scores(some.where(F.col("place") <= k), exact, wanted), "first")
    certain = kth(first.select(*key, "score"), "score", [F.desc("score")])
    rest = some.where(F.col("place") > k).join(certain.hint("merge"), key).where(F.col("upper") >= F.col("floor"))
    found = first.union(_scores(rest, exact, wanted))
    ranked = found.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
