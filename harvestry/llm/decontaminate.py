"""Benchmark decontamination: block-max WAND over a BM25 index of the test items, then overlap of question and answer.

Every text is cut into half-overlapping passages of twice the longest item, so that any item stands whole in one of
them. A passage is a query of its distinct words against the items. An item's BM25 score is divided by its score
against itself, so one threshold holds for all. The traversal is that of block-max WAND, vectorised over a batch:

1. A passage whose words' largest impacts can't reach the threshold together is left.
2. Its words in ascending order of their largest impact have a pivot: those before it can't reach the threshold together,
   so an item without any word from the pivot on is no candidate. Only posting lists from the pivot on name blocks.
3. Of these blocks, those whose words' block maxima can't reach the threshold are left.
4. The items of the blocks that remain are scored by all words.

Nothing above the threshold is lost, as every bound is an upper one. A retrieved pair counts as contaminated where the
passage holds enough of the word trigrams of the item's question and of its answer (its last sentence).

The index is built on the executors, in shards of at most SHARD items of a length class (so that a very long item widens
the passages of its own class only); word frequencies and mean length are those of all items, from an aggregation, so
scores don't depend on shards. Shards are sent to the executors in rounds of at most SENT bytes; a benchmark that takes
several rounds takes as many passes over the texts, and the driver holds one round's shards at a time.

Null or wordless texts and items match nothing, nor do items with a null id; equal items are reported each; repeated rows
give one pair; all rows with a null doc_id count as one document without a name. Items of fewer than three words must
stand there word by word. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import gather
from .common import Workspace, batch_words, map_arrow, words

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION, ANSWER = 0.6, 0.6
GRAM = 3
BLOCK = 8
SHARD = 20_000
SENT = 64 << 20  # bytes of shards that are sent at once
CLASS, CLASSES = 128, 8  # items of up to so many words are one class; each further one reaches so many times as far
EDGES = b".,;:!?\"'()[]{}<>*&%$#@|/\\-_+=~`^"
PAIRS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def bare(word: bytes) -> bytes:
    """A word without punctuation at its ends (as it is, if it is nothing else)."""
    return word.strip(EDGES) or word


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, where there are several."""
    found = words(text)
    cut = next((k for k in range(len(found) - 1, 0, -1) if found[k - 1][-1:] in b".?!" and found[k - 1][-1:]), 0)
    own = [bare(w) for w in found]
    return (own[:cut], own[cut:]) if cut else (own, [])


def grams(found: list) -> set:
    n = min(GRAM, len(found))
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if n else set()


@dataclass
class Totals:
    """What a score needs to know of all items."""

    items: int
    words: int
    longest: int
    df: Counter[bytes]

    @classmethod
    def of(cls, texts: Iterable[str]) -> Totals:
        out = cls(0, 0, 1, Counter())
        for own in filter(None, map(words, texts)):
            out.items, out.words, out.longest = out.items + 1, out.words + len(own), max(out.longest, len(own))
            out.df.update({bare(w) for w in own})
        return out


@dataclass
class Index:
    """Postings by word with impacts as shares of an item's own score, and block maxima."""

    items: list[tuple[int, set, set]]  # id, trigrams of question and answer
    vocabulary: dict[bytes, int]
    starts: np.ndarray  # of a word's postings
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # a word's largest impact
    block_starts: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    length: int  # words of the longest item

    @classmethod
    def build(cls, rows: list[tuple[int, str]], totals: Totals | None = None) -> Index:
        totals = totals or Totals.of(t for _, t in rows if t)
        parsed = [(i, *split_item(t)) for i, t in rows if t and words(t)]
        # in the words' order: every shard adds an item's impacts in the same one
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, q, a in parsed for w in q + a}))}
        terms = [[vocabulary[w] for w in q + a] for _, q, a in parsed]
        term = np.array([t for x in terms for t in x], np.int64)
        owner = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        key, tf = np.unique(term * max(len(terms), 1) + owner, return_counts=True)
        term, owner = key // max(len(terms), 1), key % max(len(terms), 1)
        n = len(terms)
        df = np.bincount(term, minlength=len(vocabulary))
        size = np.array([len(x) for x in terms], float)
        held = np.array([totals.df[w] for w in vocabulary], float)
        idf = np.log(1 + (totals.items - held + 0.5) / (held + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / (totals.words / totals.items))) if n else np.empty(0)
        impact = impact / np.bincount(owner, impact, n)[owner] if n else impact
        starts = np.concatenate(([0], np.cumsum(df)))
        top = np.maximum.reduceat(impact, starts[:-1]) if n else np.empty(0)
        bkey, first = np.unique(term * n + owner // BLOCK, return_index=True) if n else (np.empty(0, np.int64), np.empty(0, np.int64))
        block_top = np.maximum.reduceat(impact, first) if n else np.empty(0)
        block_starts = np.concatenate(([0], np.cumsum(np.bincount(bkey // max(n, 1), minlength=len(vocabulary))))).astype(np.int64)
        return cls([(i, grams(q), grams(a)) for i, q, a in parsed], vocabulary, starts, owner, impact, top, block_starts, bkey % max(n, 1), block_top, totals.longest)

    def retrieve(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all above the threshold; (window, term) pairs are distinct, sorted by window."""
        n, blocks = len(self.items), -(-len(self.items) // BLOCK)
        out: list[tuple] = []
        wins, at = np.unique(window, return_inverse=True)
        group = max(1, 50_000 // max(blocks, 1))  # passages scored at once; bounds the blocks and their postings held
        for a in range(0, len(wins), group):
            lo, hi = np.searchsorted(window, [wins[a], wins[min(a + group, len(wins)) - 1] + 1])
            w, t = at[lo:hi] - a, term[lo:hi]
            cells = min(group, len(wins) - a) * blocks
            # the pivot: words before it can't reach the threshold together
            order = np.lexsort((self.top[t], w))
            total, ascending = np.cumsum(self.top[t[order]]), w[order]
            first = np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1])))
            before = np.repeat(total[first] - self.top[t[order[first]]], np.diff(np.concatenate((first, [len(w)]))))
            from_pivot = np.empty(len(w), bool)
            from_pivot[order] = total - before >= threshold - 1e-9
            sizes = self.block_starts[t + 1] - self.block_starts[t]
            key = np.repeat(w, sizes) * blocks + gather(self.block_starts[t], sizes, self.block)
            named = np.zeros(cells, bool)
            named[key[np.repeat(from_pivot, sizes)]] = True
            keep = named[key]
            live = np.bincount(key[keep], gather(self.block_starts[t], sizes, self.block_top)[keep], cells) >= threshold
            some = live.reshape(-1, blocks).any(1)[w]
            w, t = w[some], t[some]
            sizes = self.starts[t + 1] - self.starts[t]
            item = gather(self.starts[t], sizes, self.item)
            w = np.repeat(w, sizes)
            keep = live[w * blocks + item // BLOCK]
            pair, place = np.unique(w[keep] * n + item[keep], return_inverse=True)
            score = np.bincount(place, gather(self.starts[t], sizes, self.impact)[keep], len(pair))
            hit = score >= threshold
            out.append((wins[a + pair[hit] // n], pair[hit] % n, score[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def find(batch: pa.RecordBatch, index: Index, threshold: float = THRESHOLD) -> list[tuple[int | None, int, float, float, float]]:
    """(doc_id, item_id, score, question overlap, answer overlap) of the contaminated pairs of a batch."""
    bounds, at, distinct = batch_words(batch["text"])
    if not len(at) or not index.items:
        return []
    own = [bare(w) for w in distinct]
    known = np.array([index.vocabulary.get(w, -1) for w in own], np.int64)[at]
    # half passages of `step` words; a passage is one and the next of the same text
    step = max(index.length, 32)
    n = np.diff(bounds)
    halves = np.maximum(-(-n // step), 1)
    first = np.cumsum(halves) - halves
    row = np.repeat(np.arange(len(n)), n)
    half = first[row] + (np.arange(len(at)) - bounds[row]) // step
    hits = np.flatnonzero(known >= 0)
    key = np.unique(half[hits] * len(index.vocabulary) + known[hits])
    half_of, term = key // len(index.vocabulary), key % len(index.vocabulary)
    total = int(halves.sum())
    bound = np.bincount(half_of, index.top[term], total)
    owner = np.repeat(np.arange(len(n)), halves)
    paired = np.concatenate((bound[1:], [0.0])) * np.concatenate((owner[1:] == owner[:-1], [False]))
    live = np.flatnonzero(bound + paired >= threshold)
    if not len(live):
        return []
    cut = np.searchsorted(half_of, np.arange(total + 1))
    second = np.where(np.concatenate((owner[1:] == owner[:-1], [False]))[live], live + 1, live)
    sizes = cut[second + 1] - cut[live]
    window, terms = np.repeat(live, sizes), gather(cut[live], sizes, term)
    pairs = np.unique(window * len(index.vocabulary) + terms)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    held: dict[int, set] = {}
    for w, k, score in zip(*(x.tolist() for x in index.retrieve(pairs // len(index.vocabulary), pairs % len(index.vocabulary), threshold)), strict=True):
        doc = int(owner[w])
        if w not in held:
            start = int(bounds[doc]) + (w - int(first[doc])) * step
            passage = [own[j] for j in at[start : min(start + 2 * step, int(bounds[doc + 1]))].tolist()]
            held = {w: {g for size in range(1, GRAM + 1) for g in zip(*(passage[j:] for j in range(size)), strict=False)}}
        _, question, answer = index.items[k]
        q = len(question & held[w]) / len(question) if question else 1.0
        a = len(answer & held[w]) / len(answer) if answer else 1.0
        if q >= QUESTION and a >= ANSWER:
            found[doc, k] = max(found.get((doc, k), (0.0, 0.0, 0.0)), (score, q, a))
    ids = batch["doc_id"]
    return [(ids[doc].as_py(), index.items[k][0], *x) for (doc, k), x in found.items()]


def _own_words(text: Column) -> Column:
    """The words of an item as an array, as words() and bare() find them."""
    edges = "[" + "".join(f"\\{chr(c)}" for c in EDGES) + "]+"
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bared = lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", "")
    return F.transform(found, lambda w: F.when(bared(w) == "", w).otherwise(bared(w)))


def shards(items: DataFrame, work: Workspace) -> DataFrame:
    """shard and index (pickled) of the items, at most SHARD of one length class each, more or less."""
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    own = own.withColumn("words", _own_words(F.col("text"))).withColumn("n", F.size("words").cast("bigint")).where("n > 0")
    own = own.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / CLASS) / F.log(F.lit(float(CLASSES))))).cast("int"))
    own = work.write(own, "items")
    count, total = own.agg(F.count("*"), F.sum("n")).first()
    held = own.groupBy("class").agg(F.max("n").alias("longest"), F.ceil(F.count("*") / SHARD).cast("bigint").alias("parts"))
    dealt = own.join(F.broadcast(held), "class").withColumn("shard", F.pmod(F.xxhash64("item_id"), "parts"))  # a class a row
    df = own.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known = dealt.select(F.col("class").alias("of_class"), F.col("shard").alias("of_shard"), F.explode("words").alias("word")).distinct().join(df, "word")

    def build(rows, frequencies):
        import pandas as pd

        if not len(rows):
            return pd.DataFrame({"index": []})
        totals = Totals(count, total, int(rows["longest"].iloc[0]), Counter({w.encode("utf-8", "surrogatepass"): int(n) for w, n in zip(frequencies["word"], frequencies["df"], strict=True)}))
        return pd.DataFrame({"index": [pickle.dumps(Index.build(sorted(zip(rows["item_id"].tolist(), rows["text"], strict=True)), totals))]})

    made = dealt.select("class", "shard", "item_id", "text", "longest").groupBy("class", "shard").cogroup(known.groupBy("of_class", "of_shard")).applyInPandas(build, "index binary")
    return work.write(made.select(F.monotonically_increasing_id().alias("shard"), "index"), "shards")


def rounds(items: DataFrame, work: Workspace) -> Iterator[list[Index]]:
    """The shards' indexes, as many at a time as are sent at once; the driver holds one round."""
    made = shards(items, work)
    group: list[int] = []
    held = 0
    for r in [*made.select("shard", F.length("index").alias("size")).orderBy("shard").collect(), None]:
        if group and (r is None or held + r.size > SENT):
            yield [pickle.loads(bytes(x["index"])) for x in made.where(F.col("shard").isin(group)).orderBy("shard").collect()]  # noqa: S301 - written above
            group, held = [], 0
        if r is not None:
            group.append(r.shard)
            held += r.size


def _pairs(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = [r for index in indexes for r in find(batch, index)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else None

        return work

    return map_arrow(docs, make, PAIRS)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, score and the two overlaps."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    work = Workspace(docs.sparkSession, "decontaminate")
    out = None
    for indexes in rounds(items, work):
        found = _pairs(docs, indexes)
        out = found if out is None else work.write(out, "pairs").union(found)
    out = _pairs(docs.where("false"), []) if out is None else out
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that hold no item, all columns as they are; no text is shuffled."""
    work = Workspace(docs.sparkSession, "decontaminate")
    for k, indexes in enumerate(rounds(items, work)):

        def make(indexes=indexes):
            def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
                numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch["text"]], ["doc_id", "text"])
                bad = {r[0] for index in indexes for r in find(numbered, index)}
                return batch.filter(pa.array([j not in bad for j in range(batch.num_rows)], pa.bool_()))

            return keep

        docs = map_arrow(work.write(docs, "docs") if k else docs, make, docs.schema)
    return docs
