"""Quality by a sparse ensemble of rules.

Statistics of each text (word, line and character-class shares) are computed once. On the bounded sample of labelled
documents, boosted depth-3 trees over them (each grown on SUBSAMPLE of the sample's rows, drawn anew with a fixed seed;
its steps move the margins of all rows) give candidate rules: every path from the root is a conjunction of comparisons.
A lasso logistic regression over the rules keeps a few dozen, which are compiled into one Spark column expression over
the statistics.

Null and empty texts have the statistics of a text without words. Without labelled documents every score is
1 / (1 + e**-30), with those of one kind only 1 / (1 + e**-30) or 1 / (1 + e**30). The order of the rows changes nothing.
An empty table gives an empty result. Other columns, repeated rows and null ids are kept as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import Workspace, batch_words, map_arrow

STATISTICS = (
    "words", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "upper", "digit", "symbol", "other_ascii", "high", "space",
    "lines", "distinct_lines", "words_a_line", "closed_lines", "bare_words", "pipes",
)
TREES, DEPTH, BINS, RATE, PENALTY = 40, 3, 32, 0.3, 0.002
SUBSAMPLE = 0.7

_CLASS = np.full(256, 6, np.uint8)  # 0 upper, 1 digit, 2 symbol, 3 sentence mark, 4 space, 5 lower, 6 high
_CLASS[65:91] = 0
_CLASS[48:58] = 1
_CLASS[97:123] = 5
for _c in range(128):
    if _CLASS[_c] == 6:
        _CLASS[_c] = 4 if _c in (9, 10, 11, 12, 13, 32) else 3 if chr(_c) in ".,;:'\"!?-()" else 2


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs values[bounds[k] : bounds[k + 1]], empty runs included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[bounds]).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    texts = column
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.maximum(np.diff(offsets), 1)
    kinds = _CLASS[data]
    share = [_sums(kinds == k, offsets) / size for k in range(7)]
    pipes = _sums(data == 124, offsets) / size
    bounds, index, distinct = batch_words(texts)
    index = index.astype(np.int64)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    length = np.array([len(w) for w in distinct], float)
    bare = np.array([not any(97 <= c <= 122 or c > 127 for c in w) for w in distinct], bool)
    lengths = _sums(length[index], bounds) / some if len(index) else np.zeros(len(n))
    bares = _sums(bare[index], bounds) / some if len(index) else np.zeros(len(n))
    same = np.concatenate(([False], index[1:] == index[:-1])) if len(index) else np.zeros(0, bool)
    starts = bounds[:-1][n > 0]
    same[starts] = False
    repeated = _sums(same, bounds) / some
    pair = np.concatenate(([0], index[:-1])) * (len(distinct) + 1) + index if len(index) else index
    out = np.zeros((len(n), len(STATISTICS)))
    line_rows = [t.split(b"\n") for t in column.to_pylist()]
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        lines = [x for x in line_rows[k] if x.strip()]
        m = max(len(lines), 1)
        closed = sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / m
        if b > a:
            own = np.bincount(_ranks(index[a:b]))
            words, top = len(own) / (b - a), own.max() / (b - a)
            pairs = len(np.unique(pair[a + 1 : b])) / (b - a - 1) if b - a > 1 else 1.0
        else:
            words, top, pairs = 1.0, 0.0, 1.0
        out[k] = (b - a, lengths[k], words, top, repeated[k], pairs, share[0][k], share[1][k], share[2][k], share[3][k], share[6][k], share[4][k], len(lines), len(set(lines)) / m, (b - a) / m, closed, bares[k], pipes[k])
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


@dataclass(frozen=True)
class Model:
    """Kept rules: weight and conjunction of (statistic, above, threshold); score = logistic(intercept + sum)."""

    intercept: float = 30.0
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...] = ()

    def column(self, of=F.col) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = None
            for name, above, at in conditions:
                one = of(name) > at if above else of(name) <= at
                holds = one if holds is None else holds & one
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, all_rows: np.ndarray, path: tuple, rules: set, step: np.ndarray, depth: int) -> None:
    """One Newton tree by histograms of binned statistics, grown on rows; every path goes to rules, the leaves' steps of
    all rows to step."""
    if path:
        rules.add(path)
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        gs, hs = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(x[rows, j], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(x[rows, j], h[rows], len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < 1) | (hs - hl < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[all_rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = best[1]
    below, all_below = x[rows, j] <= k, x[all_rows, j] <= k
    _grow(x, cuts, g, h, rows[below], all_rows[all_below], (*path, (j, False, k)), rules, step, depth - 1)
    _grow(x, cuts, g, h, rows[~below], all_rows[~all_below], (*path, (j, True, k)), rules, step, depth - 1)


def _boost(binned: np.ndarray, cuts: list[np.ndarray], y: np.ndarray) -> tuple[list, np.ndarray]:
    """The paths of all trees, and every row's margin after them."""
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    rng, every = np.random.default_rng(7), np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.sort(rng.permutation(len(y))[: max(20, int(len(y) * SUBSAMPLE))])
        _grow(binned, cuts, p - y, p * (1 - p), rows, every, (), found, step, DEPTH)
        margin += RATE * step
    return sorted(found), margin


def _lasso(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression with an l1 penalty, by accelerated proximal gradient steps."""
    lip = 0.25 * np.linalg.norm(a, 2) ** 2 / len(y)
    w = z = np.zeros(a.shape[1], np.float32)
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(600):
        r = 1 / (1 + np.exp(-(a @ z + c))) - y
        new = z - (a.T @ r) / len(y) / lip
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / lip, 0)
        nb = c - float(r.mean()) * 4
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def fit_rules(values: np.ndarray, y: np.ndarray) -> Model:
    """Rules from boosted trees, then lasso logistic weights by accelerated proximal gradient steps."""
    if len(y) == 0 or y.min() == y.max():
        return Model(30.0 if len(y) == 0 or y[0] else -30.0)
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(values.shape[1])]
    binned = np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rules, _ = _boost(binned, cuts, y)
    held = np.ones((len(y), len(rules)), np.float32)
    for k, path in enumerate(rules):
        for j, above, at in path:
            held[:, k] *= (binned[:, j] > at) == above
    rate = held.mean(0)
    usable = (rate > 0) & (rate < 1)
    rules, held = [r for r, u in zip(rules, usable, strict=True) if u], held[:, usable]
    held, first = np.unique(held, axis=1, return_index=True)
    rules = [rules[k] for k in first]
    centre, scale = held.mean(0), np.maximum(held.std(0), 0.05)
    a = (held - centre) / scale
    w, b = _lasso(a, y)
    kept = np.flatnonzero(w)
    weights = w[kept] / scale[kept]
    named = tuple((float(v), tuple((STATISTICS[j], above, float(cuts[j][at])) for j, above, at in rules[k])) for v, k in zip(weights, kept.tolist(), strict=True))
    return Model(float(b - (weights * centre[kept]).sum()), named)


def _with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """The rows and a struct of their statistics."""
    kind = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = statistics(batch["text"])
            struct = pa.StructArray.from_arrays([pa.array(x[:, j]) for j in range(len(STATISTICS))], fields=list(kind))
            return pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

        return work

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])
    return map_arrow(docs, make, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The rules from the labelled documents that aren't held out; the driver gets their statistics, a bounded number."""
    work = Workspace(docs.sparkSession, "quality")
    known = work.write(_with_statistics(labelled.sample(docs, labels, "quality"), "statistics").select("y", "statistics.*"), "sample")
    rows = known.toArrow()
    work.drop(known)
    x = np.stack([rows[s].to_numpy() for s in STATISTICS], 1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)  # any order of the rows gives the same rules
    return fit_rules(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the statistics of every row."""
    rows = _with_statistics(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), "statistics")
    return rows.select("doc_id", model.column(lambda s: F.col(f"statistics.{s}")).alias("score"), "statistics")


def keep_good(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows whose score reaches the limit, all columns as they are."""
    name = "statistics"
    while name in docs.columns:
        name += "_"
    rows = _with_statistics(docs, name)
    return rows.where(model.column(lambda s: F.col(name).getField(s)) >= limit).select(*[F.col(f"`{c}`") for c in docs.columns])
