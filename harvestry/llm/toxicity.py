"""Toxicity by maximum-scoring segments.

Fit, on the bounded sample of labelled documents: each word's log-odds between toxic and other documents under an
informative Dirichlet prior (the pooled counts), kept where its z-score is significant. A word counts once a text, so
that a long or repetitive text weighs no more than another, and once among near copies. Every other word costs DRIFT.
The linear-time scan for all maximal-scoring segments then runs over every word of every text. A segment's score S in
a text of n words has the extreme-value tail 1 - exp(-K n exp(-lambda S)): lambda solves sum p exp(lambda s) = 1 over
the word scores of clean documents, K is fitted to their highest segments. A document's statistic adds up the
significant segments' scores in nats; a logistic curve fitted on the same sample makes it a score from 0 to 1.

Null and empty texts have no segment and the score of a text without one. Without labelled documents of both kinds every
score is 1 / (1 + e**30), 1e-13. The order of the rows changes nothing. An empty table gives an empty result. Other
columns, repeated rows and null ids are kept as they come.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import Workspace, batch_shingles, batch_words, map_arrow

PRIOR = 1.0  # weight of the whole prior, as a multiple of the toxic class's count
MIN_Z = 4.0  # one in 30,000
LEXICON = 20_000  # words kept at most, by z; bounds the model that is sent to the executors
DRIFT = 0.1
E_VALUE = 0.05
SEGMENT = "array<struct<first:int,last:int,score:double,e_value:double>>"
EDGES = b".,;:!?\"'()[]{}<>*&%$#@|/\\-_+=~`^"


@dataclass(frozen=True)
class Model:
    """Word scores and their calibration."""

    lexicon: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = -30.0
    slope: float = 0.0


def word_scores(distinct: list[bytes], lexicon: dict[bytes, float]) -> np.ndarray:
    return np.array([lexicon.get(w.strip(EDGES), -DRIFT) for w in distinct], np.float64)


def segments(positions: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence whose positive scores stand at the positions and
    whose other scores are -drift; one pass, each candidate is merged at most once."""
    found: list[list[float]] = []  # first, last, total before it, total with it
    total, before = 0.0, -1
    for at, s in zip(positions, scores, strict=True):
        total -= drift * (at - before - 1)
        before = at
        start, total = total, total + s
        new = [at, at, start, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(int(a), int(b), r - lo) for a, b, lo, r in found]


def _scan(batch: pa.RecordBatch, lexicon: dict[bytes, float]):
    """Number of words and maximal segments of each text."""
    bounds, index, distinct = batch_words(batch["text"])
    scores = word_scores(distinct, lexicon)
    per_word = scores[index] if len(index) else np.empty(0)
    hits = np.flatnonzero(per_word > 0)
    cuts = np.searchsorted(hits, bounds)
    for k in range(len(bounds) - 1):
        own = hits[cuts[k] : cuts[k + 1]]
        n = int(bounds[k + 1] - bounds[k])
        yield n, segments((own - bounds[k]).tolist(), per_word[own].tolist()) if len(own) else []


def _statistic(n: int, found: list[tuple[int, int, float]], rate: float, k: float) -> tuple[float, list[tuple[int, int, float, float]]]:
    kept = [(a, b, s, e) for a, b, s in found if (e := k * n * math.exp(-rate * s)) <= E_VALUE]
    return sum(-math.log(max(e, 1e-300) / E_VALUE) + 1 for *_, e in kept), kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled documents that aren't held out. What reaches the driver is bounded by LEXICON words
    and three numbers for each of the sample's documents."""
    work = Workspace(docs.sparkSession, "toxicity")

    def mark():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [int(x.min().view(np.int64)) if len(x) else 0 for x in batch_shingles(batch["text"])]
            return pa.RecordBatch.from_arrays([batch["text"], batch["y"], pa.array(marks, pa.int64())], ["text", "y", "mark"])

        return run

    known = work.write(map_arrow(labelled.sample(docs, labels, "toxic"), mark, "text string, y int, mark bigint"), "sample")

    def count():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            bounds, index, distinct = batch_words(batch["text"])
            bare = pa.array([w.strip(EDGES) for w in distinct], pa.binary()).dictionary_encode()
            words = len(bare.dictionary)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            once = np.unique(row * words + bare.indices.to_numpy()[index])
            toxic = np.array(batch["y"].to_pylist(), bool)[once // max(words, 1)]
            n1 = np.bincount(once[toxic] % max(words, 1), minlength=words)
            n0 = np.bincount(once[~toxic] % max(words, 1), minlength=words)
            return pa.RecordBatch.from_arrays([bare.dictionary, pa.array(n1, pa.int64()), pa.array(n0, pa.int64())], ["word", "toxic", "other"])

        return run

    # near copies share their smallest shingle, mostly: one of them (the least text, whatever the rows' order) is counted,
    # or its rare words would look significant
    counts = work.write(map_arrow(known.groupBy("mark", "y").agg(F.min("text").alias("text")), count, "word binary, toxic bigint, other bigint").groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum("other").alias("y0")), "counts")
    n1, n0 = (x or 0 for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        return Model()
    weight = PRIOR * n1
    prior = (F.col("y1") + F.col("y0")) * F.lit(weight / (n1 + n0))
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + weight) - F.col(y) - prior))
    scored = counts.where("y1 + y0 > 0").withColumn("score", odds("y1", n1) - odds("y0", n0)).withColumn("z", F.col("score") / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior)))
    rows = scored.where((F.col("z") >= MIN_Z) & (F.length("word") > 0)).orderBy(F.desc("z"), "word").limit(LEXICON).select("word", "score", "y0").collect()
    lexicon = {bytes(r.word): r.score for r in rows if r.score > 0}
    if not lexicon:
        return Model()

    # lambda: the positive root of sum p exp(lambda s) = 1 over clean documents
    s = np.array([r.score for r in rows if r.score > 0])
    p = (np.array([r.y0 for r in rows if r.score > 0], float) + 0.5) / (n0 + 0.5 * len(s))
    excess = lambda rate: float((p * np.exp(rate * s)).sum() + max(0.0, 1 - p.sum()) * math.exp(-rate * DRIFT) - 1)
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    rate = max(high, 1e-6)

    def scan():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(n, [x[2] for x in found]) for n, found in _scan(batch, lexicon)]
            return pa.RecordBatch.from_arrays([batch["y"], pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["y", "n", "scores"])

        return run

    # the sample is small, but its longest lists aren't bounded by its rows: only the sums that the fit needs come back
    seen = work.write(map_arrow(known, scan, "y int, n bigint, scores array<double>"), "scores")
    top = seen.where("y = 0 and size(scores) > 0").agg(F.avg(F.array_max("scores") * rate - F.log("n")), F.count("*")).first()
    clean = seen.where("y = 0 and n > 0").agg(F.avg(F.log("n")), F.count("*")).first()
    # Gumbel mean: log K + Euler's constant; clean documents without any segment lie below every one with
    k = math.exp(top[0] - 0.5772) if top[1] else math.exp(-(clean[0] or 0.0))
    k *= max(top[1], 1) / max(clean[1], 1)
    each = F.filter(F.transform("scores", lambda x: F.lit(math.log(k)) + F.log("n") - x * rate), lambda e: e <= math.log(E_VALUE))
    stat = F.aggregate(each, F.lit(0.0), lambda a, e: a - e + (math.log(E_VALUE) + 1))
    data = seen.select("y", F.coalesce(stat, F.lit(0.0)).alias("x")).collect()
    x, y = np.array([r.x for r in data]), np.array([r.y for r in data], float)
    intercept, slope = _logistic(np.log1p(x), y)
    work.drop(known, counts, seen)
    return Model(lexicon, rate, k, intercept, slope)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge for separable data."""
    a, w = np.stack((np.ones_like(x), x), 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _scored(batch: pa.RecordBatch, model: Model):
    for n, found in _scan(batch, model.lexicon):
        x, kept = _statistic(n, found, model.rate, model.k)
        yield 1 / (1 + math.exp(-min(30.0, max(-30.0, model.intercept + model.slope * math.log1p(x))))), kept


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score and (with ``spans``) the significant segments, as word positions, of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(_scored(batch, model))
            arrays = [batch["doc_id"], pa.array([r[0] for r in rows], pa.float64()), pa.array([len(r[1]) for r in rows], pa.int32())]
            names = ["doc_id", "score", "n_segments"]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
                arrays.append(pa.array([[{"first": a, "last": b, "score": s, "e_value": e} for a, b, s, e in r[1]] for r in rows], kind))
                names.append("segments")
            return pa.RecordBatch.from_arrays(arrays, names)

        return work

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id bigint, score double, n_segments int" + f", segments {SEGMENT}" * spans)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below the limit, all columns as they are."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([s < limit for s, _ in _scored(batch, model)], pa.bool_()))

        return work

    return map_arrow(docs, make, docs.schema)
