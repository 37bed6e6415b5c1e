"""Near-duplicate classes: MinHash bands, sequential Bayesian verification, exact confirmation, components.

1. Every text's set of distinct 5-word shingles (64-bit hashes) gives a MinHash signature and a 128-bit digest of the
   set. Rows with equal sets are one class; only classes are compared, each under a number of its own.
2. The signatures' first entries are cut into bands. Each bucket links its members to its smallest member (a star: one
   candidate a row), and the confirmed links make components.
3. In every bucket that still holds several components, members of different components are compared by their
   signatures in blocks of at most CELL members: none against all of a bucket whose members one component holds, none
   where the set sizes rule a link out, and each pair in its first common bucket only. Pairs within one component need
   no check: their link would change nothing. So every pair that shares a bucket is connected, or was compared.
4. A comparison looks at the signatures batch by batch. After each batch the posterior probability that the similarity
   reaches the threshold (uniform prior: a beta distribution) is compared with the chosen miss probability; a pair below
   it is pruned.
5. Survivors are confirmed on their full sets. Those of stars (one a member and bucket at most) are joined with the
   sets. Those of blocks never become rows, as a bucket may hold the square of its members: the first pass over the
   blocks names only the members that have a surviving pair, the second brings these members' full sets into blocks of
   bounded size, confirms every surviving pair there and yields links that connect what is linked, a forest a block.

At similarity 0.75 a pair shares no bucket with probability (1 - 0.75 ** ROWS) ** BANDS (2e-5), and is then pruned
wrongly by any of the looks together with probability 8.4e-6 (lost(); both fall steeply above).

Null and empty texts have no shingle and are linked with nothing; a null id gives a null component and is kept. Repeated
rows each keep a row, with equal results. Rows that share an id but not a text are one document with several texts: it is
linked by any of them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import gather
from .common import Workspace, batch_shingles, map_arrow, mix, release
from .graph import components

ROWS, BANDS = 5, 40
ENTRIES = 320  # of a signature; the first ROWS * BANDS make the bands
NUMERATOR, DENOMINATOR = 75, 100
MISS = 1e-6  # at each look; lost() adds the looks up
BATCH = 32  # signature entries compared between two looks at the posterior
SIEVE_BITS = 26  # at most 8 MB
CELL = 512  # members of a bucket that are compared as one block
CELL_SHINGLES = 1 << 19  # of the full sets in one block (4 MB), but for a single set

SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"


@functools.cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def minhash(sets: list[np.ndarray], n: int = ENTRIES) -> np.ndarray:
    """The low 16 bits of n minima of 32-bit multiply-add hashes of each non-empty set: a row a set."""
    a, b = _seeds(n)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    out = np.empty((n, len(sets)), "<u2")
    h = np.empty_like(x)
    for k in range(n):
        np.multiply(x, a[k], out=h)
        h += b[k]
        h ^= h >> np.uint32(15)
        out[k] = np.minimum.reduceat(h, starts)
    return np.ascontiguousarray(out.T)


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128 bits of each set, the same for any order of its shingles; 0 for an empty one."""
    d1 = [int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0 for s in sets]
    d2 = [int(np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))).view(np.int64)) if len(s) else 0 for s in sets]
    return pa.array(d1, pa.int64()), pa.array(d2, pa.int64())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the set's 128-bit digest (d1, d2) and the MinHash signature of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(s) for s in batch_shingles(batch["text"])]
            some = [s for s in sets if len(s)]
            rows = iter(minhash(some) if some else ())
            sig = [next(rows).tobytes() if len(s) else None for s in sets]
            arrays = [batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()), *_digests(sets), pa.array(sig, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])

        return work

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), "text"), make, SIGNED)


def text_hash(text: str = "text") -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def sieve(wanted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the wanted ids (doc_id): bits as uint64 words. Its size is bounded whatever is wanted: beyond
    the bound it lets more others through, never fewer of the wanted."""
    bits = 1 << min(SIEVE_BITS, max(16, (16 * size).bit_length()))
    h = F.xxhash64("doc_id")
    places = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
    words = wanted.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    out = np.zeros(bits >> 6, np.uint64)
    rows = words.toArrow()
    out[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    return out, bits


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingle hashes (sorted longs) of the wanted sets (id, and doc_id, d1, d2 of a row that has it). A Bloom
    filter of their doc_ids goes to the texts, so that only sets are shuffled, not texts."""
    words, bits = sieve(wanted.select("doc_id"), wanted.count())
    keyed = docs.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            h = batch["h"].to_numpy().view(np.uint64)
            hit = np.ones(len(h), bool)
            for place in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
                hit &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
            at = pa.array(np.flatnonzero(hit))
            if not len(at):
                return None
            sets = [np.unique(s) for s in batch_shingles(batch["text"].take(at))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch["doc_id"].take(at), *_digests(sets), lists], ["doc_id", "d1", "d2", "shingles"])

        return work

    key = ["doc_id", "d1", "d2"]
    found = map_arrow(keyed, make, "doc_id bigint, d1 bigint, d2 bigint, shingles array<bigint>")
    return found.groupBy(*key).agg(F.first("shingles").alias("shingles")).join(wanted.select("id", *key), key).select("id", "shingles")


def _posterior_tail(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of n signature entries), uniform prior: a beta tail as a binomial sum."""
    total = n + 1
    return math.fsum(math.comb(total, j) * threshold**j * (1 - threshold) ** (total - j) for j in range(matches + 1))


@functools.cache
def needed_matches(n: int = ENTRIES, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """After so many entries a pair needs so many matches, or it is pruned."""
    threshold = NUMERATOR / DENOMINATOR
    out = []
    for seen in range(batch, n + 1, batch):
        need = next(m for m in range(seen + 1) if _posterior_tail(m, seen, threshold) > miss)
        out.append((seen, need))
    return out


def lost(similarity: float) -> float:
    """The probability that a pair of this similarity is pruned by any of the looks."""
    live, seen, out = {0: 1.0}, 0, 0.0
    for upto, need in needed_matches():
        step = upto - seen
        chance = [math.comb(step, j) * similarity**j * (1 - similarity) ** (step - j) for j in range(step + 1)]
        after: dict[int, float] = {}
        for matches, p in live.items():
            for j, q in enumerate(chance):
                after[matches + j] = after.get(matches + j, 0.0) + p * q
        out += math.fsum(p for m, p in after.items() if m < need)
        live, seen = {m: p for m, p in after.items() if m >= need}, upto
    return out


def survivors(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sequential Bayesian test doesn't prune. sigs: id, n, sig."""
    left = sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR).select("a", "b", "sa", "sb")
    steps = needed_matches()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            sa, sb = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, ENTRIES) for c in ("sa", "sb"))
            at, matches, seen = np.arange(len(sa)), np.zeros(len(sa), np.int64), 0
            for upto, need in steps:
                matches = matches + (sa[at, seen:upto] == sb[at, seen:upto]).sum(1)
                keep = matches >= need
                at, matches, seen = at[keep], matches[keep], upto
            return batch.select(["a", "b"]).take(pa.array(at)) if len(at) else None

        return work

    return map_arrow(near, make, "a bigint, b bigint", None)


class _Cell:
    """One block of a bucket's members: ids, components, set sizes, signatures and (if there) full sets."""

    def __init__(self, column: pa.ListArray):
        fields = column.flatten()
        named = dict(zip([f.name for f in fields.type], fields.flatten(), strict=True))
        self.id, self.component, self.n = (named[c].to_numpy() for c in ("id", "component", "n"))
        self.sig = np.frombuffer(b"".join(named["sig"].to_pylist()), "<u2").reshape(-1, ENTRIES)
        if "shingles" in named:
            self.values = named["shingles"].flatten().to_numpy()
            self.starts = np.concatenate(([0], np.cumsum(self.n)))


def _passing(x: _Cell, y: _Cell, same: bool, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places in x and y of the pairs of different components that pass the Bayesian test and have no earlier common
    bucket than that of this band."""
    steps = needed_matches()
    for k in range(len(x.id)):
        at = np.flatnonzero((y.component != x.component[k]) & (np.minimum(y.n, x.n[k]) * DENOMINATOR >= np.maximum(y.n, x.n[k]) * NUMERATOR))
        if same:
            at = at[at > k]
        matches, seen = np.zeros(len(at), np.int64), 0
        for upto, need in steps:
            if not len(at):
                break
            matches = matches + (y.sig[at, seen:upto] == x.sig[k, seen:upto]).sum(1)
            keep = matches >= need
            at, matches, seen = at[keep], matches[keep], upto
        if len(at):
            shared = (y.sig[at, : ROWS * BANDS] == x.sig[k, : ROWS * BANDS]).reshape(len(at), BANDS, ROWS).all(2)
            at = at[shared.argmax(1) == band]
            if len(at):
                yield k, at


def _named(x: _Cell, y: _Cell, same: bool, band: int) -> np.ndarray:
    """The ids of members with a passing pair."""
    left, right = np.zeros(len(x.id), bool), np.zeros(len(y.id), bool)
    for k, at in _passing(x, y, same, band):
        left[k] = True
        right[at] = True
    return np.union1d(x.id[left], y.id[right])


def _forest(x: _Cell, y: _Cell, same: bool, band: int) -> list[tuple[int, int]]:
    """Links (ids) between the components that passing pairs with similar enough full sets connect."""
    numbers = np.unique(np.concatenate((x.values, y.values)), return_inverse=True)[1]
    xs, ys = numbers[: len(x.values)], numbers[len(x.values) :]
    held = np.zeros(int(numbers.max(initial=-1)) + 1, bool)
    head: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := head.get(c, c)) != c:
            head[c] = head.get(up, up)
            c = up
        return c

    out = []
    for k, at in _passing(x, y, same, band):
        own = xs[x.starts[k] : x.starts[k + 1]]
        held[own] = True
        sizes = y.n[at]
        inside = held[gather(y.starts[at], sizes, ys)]
        held[own] = False
        common = np.add.reduceat(inside, np.cumsum(sizes) - sizes, dtype=np.int64)
        for j in at[common * DENOMINATOR >= (sizes + x.n[k] - common) * NUMERATOR].tolist():
            a, b = find(int(x.component[k])), find(int(y.component[j]))
            if a != b:
                head[b] = a
                out.append((int(x.id[k]), int(y.id[j])))
    return out


def _meet(rows: DataFrame, columns: list[str], load: Column, handle, schema: str) -> DataFrame:
    """handle(x, y, same, hash, band) of every two blocks of a bucket whose members may be linked.

    rows: hash, band, id, component, main, n and the columns of a member. A bucket's members are dealt to blocks by set
    size and by whether they belong to the component of the bucket's head (main); blocks of that component alone don't
    meet. load: the members' share of what a block may hold.
    """
    rows = rows.withColumn("size", F.floor(F.log("n") / math.log(DENOMINATOR / NUMERATOR)).cast("int")).withColumn("outer", F.col("component") != F.col("main"))
    key = ["hash", "band", "size", "outer"]
    parts = rows.groupBy(*key).agg(F.ceil(F.sum(load)).cast("int").alias("parts"))
    rows = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
    cells = rows.groupBy(*key, "part").agg(F.collect_list(F.struct("id", "component", *columns)).alias("cell"), F.min("component").alias("low"), F.max("component").alias("high"))
    x = cells.select("hash", "band", "size", "outer", "part", F.col("cell").alias("x"), "low", "high")
    y = cells.select("hash", "band", F.col("size").alias("size2"), F.col("outer").alias("outer2"), F.col("part").alias("part2"), F.col("cell").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    first, second = F.struct("size", "outer", "part"), F.struct("size2", "outer2", "part2")
    one = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    pairs = x.join(y, ["hash", "band"]).where((first <= second) & (F.col("size2") <= F.col("size") + 1) & ~one).select("hash", "band", "x", "y", (first == second).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                where = [row[c][0].as_py() for c in ("same", "hash", "band")]
                if (found := handle(_Cell(row["x"]), _Cell(row["y"]), *where)) is not None:
                    yield found
            release()

    return pairs.mapInArrow(run, schema)


def cross_members(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """hash, band and id of the members that have a pair of different components, in their first common bucket, that
    passes the Bayesian test.

    members: hash, band, id, component, main (the component of the bucket's head) of the buckets with several.
    """

    def handle(x: _Cell, y: _Cell, same: bool, key: int, band: int) -> pa.RecordBatch | None:
        found = _named(x, y, same, band)
        return pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([band] * len(found), pa.int32()), pa.array(found, pa.int64())], ["hash", "band", "id"]) if len(found) else None

    return _meet(members.join(sigs, "id"), ["n", "sig"], F.lit(1 / CELL), handle, "hash bigint, band int, id bigint").distinct()


def cross_links(members: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components of all pairs that pass the test and are similar enough by their full
    sets. members: as before, those that cross_members names; sets: id, shingles."""

    def handle(x: _Cell, y: _Cell, same: bool, key: int, band: int) -> pa.RecordBatch | None:
        found = _forest(x, y, same, band)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], ["a", "b"]) if found else None

    load = F.greatest(F.lit(1 / CELL), F.col("n") / F.lit(CELL_SHINGLES))
    return _meet(members.join(sigs, "id").join(sets, "id"), ["n", "sig", "shingles"], load, handle, "a bigint, b bigint")


def verify(left: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. sets: id, shingles.

    The sets travel as 32-bit hashes first; only pairs near the threshold there or above are joined with the full sets.
    """

    def check(pairs: DataFrame, hashes: Column, percent: int) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), hashes.alias("xa"))
        b = sets.select(F.col("id").alias("b"), hashes.alias("xb"))
        common = F.size(F.array_intersect("xa", "xb")).cast("bigint")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("common"), (F.size("xa") + F.size("xb")).alias("both"))
        return both.where(F.col("common") * DENOMINATOR >= (F.col("both") - F.col("common")) * percent).select("a", "b")

    short = F.array_distinct(F.transform("shingles", lambda h: F.shiftright(h, 32).cast("int")))
    near = work.write(check(left, short, NUMERATOR - 1), "near")
    links = work.write(check(near, F.col("shingles"), NUMERATOR), "links")
    work.drop(near)
    return links


def _linked(docs: DataFrame, work: Workspace, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The classes (id, doc_id, d1, d2: of the smallest row), the component of each class that has one (node, component), the
    rows with a set (doc_id, text_hash, n_shingles, id) and the others. by_id: classes of one doc_id are linked."""
    signed = work.write(signatures(docs), "signed")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    alone = work.write(signed.where(~usable).select("doc_id", "text_hash", "n_shingles"), "alone")
    key = ["d1", "d2", "n_shingles"]
    # one class for each set, whatever ids its rows have; equal sets have equal signatures. Numbers that are written stay
    made = signed.where(usable).groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    made = work.write(made.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = work.write(signed.where(usable).select("doc_id", "text_hash", *key).join(made.select("id", *key), key).select("doc_id", "text_hash", "n_shingles", "id"), "rows")
    work.drop(signed)
    sigs = made.select("id", F.col("n_shingles").alias("n"), "sig")
    named = made.select("id", "doc_id", "d1", "d2")

    def full_sets(ids: DataFrame) -> DataFrame:
        wanted = work.write(ids.distinct().join(named, "id"), "wanted")
        sets = work.write(shingle_sets(docs, wanted), "sets")
        work.drop(wanted)
        return sets

    width = 2 * ROWS
    pieces = [F.substring("sig", 1 + width * k, width) for k in range(BANDS)]
    bands = sigs.select("id", F.posexplode(F.array(*[F.xxhash64(p, F.lit(k)) for k, p in enumerate(pieces)])).alias("band", "hash"))
    buckets = bands.groupBy("hash", "band").agg(F.min("id").alias("head"), F.count("*").alias("members")).where("members > 1").select("hash", "band", "head")
    members = work.write(bands.join(buckets, ["hash", "band"]), "members")

    stars = members.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    left = work.write(survivors(stars, sigs), "survivors")
    sets = full_sets(left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))))
    first = work.write(components(verify(left, sets, work), work), "first")
    work.drop(left, sets)

    # members with their component, and those of the buckets that hold more than one
    node = first.select(F.col("node").alias("id"), "component")
    placed = members.join(node, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = placed.where("id = head").select("hash", "band", F.col("component").alias("main"))
    placed = work.write(placed.join(heads, ["hash", "band"]), "placed")
    mixed = placed.where("component != main").select("hash", "band").distinct()
    inside = placed.join(mixed, ["hash", "band"]).select("hash", "band", "id", "component", "main")
    some = work.write(cross_members(inside, sigs), "some")
    sets = full_sets(some.select("id"))
    more = work.write(cross_links(placed.join(some, ["hash", "band", "id"]).select("hash", "band", "id", "component", "main"), sigs, sets), "more")
    work.drop(members, placed, some, sets)
    links = more
    if by_id:
        several = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
        links = links.union(rows.join(several, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct())

    # the links between components, and what they join
    for c in ("a", "b"):
        links = links.join(first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    merged = work.write(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), work), "merged")
    total = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    loose = merged.join(first.select("node"), "node", "left_anti").select("node", "component")
    total = work.write(total.union(loose), "total")
    work.drop(first, merged, more)
    return named, total, rows, alone


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    named, total, rows, alone = _linked(docs, Workspace(docs.sparkSession, "neardup"), True)
    placed = named.select("id", "doc_id").join(total.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("doc_id").alias("own"))
    least = placed.groupBy("component").agg(F.min("own").alias("component_id"))
    of_class = placed.join(least, "component").select("id", "component_id")
    linked = rows.join(of_class, "id").select("doc_id", "n_shingles", "component_id")
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns as they are: that of the smallest id (of rows that repeat it,
    an arbitrary one of one text). Decided by text: rows that share an id but not a text aren't linked by that. Rows
    with a null id or without words stay."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named, total, rows, _ = _linked(own, Workspace(docs.sparkSession, "neardup"), False)
    place = F.struct("doc_id", "d1", "d2", "id")
    component = F.coalesce("component", "id")
    best = named.join(total.withColumnRenamed("node", "id"), "id", "left").groupBy(component.alias("component")).agg(F.min(place).alias("best")).select(F.col("best.id").alias("id"), F.col("best.doc_id").alias("doc_id"))
    hash_name, id_name = "text_hash", "kept_id"
    while hash_name in docs.columns or id_name in docs.columns:
        hash_name, id_name = f"{hash_name}_", f"{id_name}_"
    kept = rows.join(best, ["id", "doc_id"]).groupBy("id", F.col("doc_id").alias(id_name)).agg(F.min("text_hash").alias(hash_name))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    found = docs.where(worded).withColumn(hash_name, text_hash()).withColumn(id_name, F.col("doc_id").cast("bigint"))
    found = found.dropDuplicates([id_name, hash_name]).join(kept, [id_name, hash_name], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns).union(docs.where(~worded).select(*columns))
