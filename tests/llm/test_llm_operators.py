"""Every operator against a brute-force version or the library that it must equal, and the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers
from tokenizers.models import Unigram

from harvestry.llm import bpe, chunks, common, counts, decontaminate, graph, neardup, quality, revisits, toxicity, vafile, wavelet, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
BITS = ["a", "aa", " ", "  ", "\n", "\t", " ", "é", "漢", "'s", "'ll", "1", "23", ".", "..", "b", "the", " th", "ation", " ", "<|endoftext|>", "x" * 40, "\r", "ab", "aba", "\0", "\x85", " ", "<unk>", "<0x41>", "▁", "𝄞"]
TEXTS = ["".join(RNG.choice(BITS) for _ in range(RNG.randint(0, 30))) for _ in range(1500)] + [" ", "  ", "   ", " a", "a ", "a  ", "", " \n", None, "long " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0), (None, "no id", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("n_tokens", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(flat, sizes):
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


# ---- token ids -------------------------------------------------------------------------------------------------


def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(docs, empty):
    ref = reference_bpe()
    want = Counter()
    for r in docs.collect():
        ids = ref.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(docs, P.path(bpe.RANKS_FILE), digests=True).collect())) == want
    plain = {r.doc_id: r for r in bpe.encode_decode(docs, P.path(bpe.RANKS_FILE)).collect()}
    assert bytes(plain[0].decoded) == (TEXTS[0] or "").encode()
    assert bpe.encode_decode(empty, P.path(bpe.RANKS_FILE)).count() == 0


def test_merge_order_of_overlaps():
    coder = bpe._coder(P.path(bpe.RANKS_FILE), P.PATTERN)
    ref = reference_bpe()
    words = ["a" * n for n in range(1, 40)] + ["".join(RNG.choice("abc") for _ in range(RNG.randint(1, 25))) for _ in range(500)]
    got = ids_of(*coder.replay([w.encode() for w in words]))
    assert got == [ref.encode_ordinary(w) for w in words]


def test_small_caches_change_nothing():
    coder = bpe._coder(P.path(bpe.RANKS_FILE), P.PATTERN)
    tight = chunks.Encoder(coder.pattern.findall, coder.replay_strings, 50)
    column = pa.array(TEXTS[:400])
    assert ids_of(*tight.encode(column.slice(7, 90))) == ids_of(*coder.encoder.encode(column.slice(7, 90)))
    assert ids_of(*tight.encode(column)) == ids_of(*coder.encoder.encode(column))


def test_library_encoder_equals_library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert ids_of(*wavelet._tokenizer(P.path("byte_bpe_50k.json")).encode(pa.array(TEXTS))) == [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_wavelet_matrix():
    ids = np.array([RNG.choice([0, 5, 7, 50_000, 300, 301]) for _ in range(150_001)], "<u4")
    r = wavelet.Reader(wavelet.build(ids, [1, None, 3], [100_000, 1, 50_000]))
    assert (r.tokens() == ids).all() and r.doc_ids == [1, None, 3]
    assert [r.access(i) for i in (0, 65_535, 65_536, 150_000)] == ids[[0, 65_535, 65_536, 150_000]].tolist()
    for t in (0, 301, 50_000, 9, 70_000):
        at = np.flatnonzero(ids == t)
        assert r.count(t) == len(at) and r.count(t, 70_000, 140_001) == ((at >= 70_000) & (at < 140_001)).sum()
        for j in (0, len(at) // 2, len(at) - 1) if len(at) else ():
            assert r.select(t, j) == at[j]
    with pytest.raises(IndexError):
        r.select(9, 0)
    none = wavelet.Reader(wavelet.build(np.empty(0, "<u4"), [], []))
    assert none.n == 0 and len(none.tokens()) == 0


def test_token_index(docs, empty, monkeypatch):
    monkeypatch.setattr(wavelet, "FILE_TOKENS", 5000)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = wavelet.token_index(docs, P.path("byte_bpe_50k.json")).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at, want = 0, Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        at += len(ids)
    assert Counter(map(tuple, got)) == want
    assert wavelet.token_index(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_counts_of_an_empty_table(empty):
    assert counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_counts_equal_unigram(docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    tok = Tokenizer(Unigram([(m.id_to_piece(k), m.get_score(k)) for k in range(m.vocab_size())], 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace()
    got = Counter((r.doc_id, r.n_tokens) for r in counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect())
    assert got == Counter((r.doc_id, len(tok.encode(r.text or "").tokens)) for r in docs.collect())


def test_counts_ties_and_runs_without_bytes():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -1.0)]
    tok = Tokenizer(Unigram(vocabulary, 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace()
    c = counts.Counter(vocabulary, 0, False)
    for text in ("aaa", "a aa", "xx a", "axxb", "aaaa b"):
        assert c.texts(pa.array([text]))[0].tolist() == [len(tok.encode(text).tokens)], text


# ---- near duplicates -------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    own = sorted(sets)
    for a in range(len(own)):
        for b in range(a):
            x, y = sets[own[a]], sets[own[b]]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(own[a]), find(own[b])
                head[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rows += [None, "", "  ", "one", "ONE", "one two three four", "one two three four five", "one two three four five"]
    numbered = [(k * 7 % 1009, t) for k, t in enumerate(rows)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in numbered] + [(None, "one two", "en", "s", 0)], DOCS).withColumn("id", F.lit(1)).withColumn("hash", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(frame).collect()}
    assert got.pop(None) == (1, None, True)
    assert got == brute_components(numbered)
    assert neardup.classes(empty).count() == 0
    twice = neardup.classes(frame.union(frame)).where("doc_id is not null")
    assert Counter((r.doc_id, r.component_id) for r in twice.collect()) == Counter({(i, v[1]): 2 for i, v in got.items()})


def test_blocks_lose_no_pair(spark, monkeypatch):
    """With cells of a few members a bucket is compared over many cells; the result must not change."""
    monkeypatch.setattr(neardup, "CELL", 3)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.035 else f"x{rng.random()}" for w in base)) for k in range(90)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_one_id_with_several_texts(spark):
    """A document with two texts is linked by both, whichever stands for a class; by text, nothing links them."""
    rows, expected = [], {}
    for g in range(4):
        word = lambda tag, n, g=g: [f"{tag}{g}_{k}" for k in range(n)]
        a, b = word("a", 40), word("b", 40)
        i = 10 * g
        rows += [(i + 1, " ".join(a)), (i + 1, " ".join(b)), (i + 2, " ".join([*a[:-1], "x"])), (i + 3, " ".join([*b[:-1], "y"])), (i + 4, " ".join(word("c", 9)))]
        expected |= {i + 1: i + 1, i + 2: i + 1, i + 3: i + 1, i + 4: i + 4}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (frame.orderBy(F.desc("doc_id"), F.desc("text")),):
        got = neardup.classes(df).collect()
        assert {r.doc_id: r.component_id for r in got} == expected and len(got) == len(rows)
        left = neardup.keep_one(df).collect()
        assert sorted((r.doc_id, r.text) for r in left) == sorted(r for r in rows if r[0] % 10 in (1, 4))


def test_one_row_of_a_group_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, 0), (1, a, 0), (1, a.upper(), 1), (2, a, 2), (3, b, 3), (3, a, 4), (4, None, 5), (4, " ", 6), (None, a, 7), (5, b + " z", 8), (5, "", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_hash long").withColumn("id", F.lit(1))
    left = neardup.keep_one(frame)
    assert left.columns == frame.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect()) == sorted([("1", a), ("3", b), ("4", ""), ("4", " "), ("None", a), ("5", "")])


def test_members_in_pieces(spark, monkeypatch):
    """Blocks bounded by their shingles, and components that only blocks of other sizes connect."""
    monkeypatch.setattr(neardup, "CELL", 5)
    monkeypatch.setattr(neardup, "CELL_SHINGLES", 120)
    rng = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"w{g}_{k}" for k in range(70)]
        rows += [(len(rows) + 7 * k % 100, " ".join(w if rng.random() > 0.03 else f"x{rng.random()}" for w in base[: rng.choice([56, 62, 70])])) for k in range(60)]
    rows = list(dict(rows).items())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_no_link_is_lost_on_the_small_tables(spark):
    """Against an exact set-similarity join of all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_signature_estimates_similarity():
    x = np.random.default_rng(1).integers(0, 2**63, 1100).astype(np.uint64)
    a, b = neardup.minhash([x[:1000], x[100:]], 4000)
    assert abs((a == b).mean() - 900 / 1100) < 0.03
    steps = neardup.needed_matches()
    assert steps[-1][0] == neardup.ENTRIES and all(a < b for (_, a), (_, b) in zip(steps, steps[1:], strict=False))


def test_looks_together_keep_the_stated_bound():
    """The looks' losses add up; at 1e-3 each, 0.66 % of the pairs at the threshold were pruned."""
    assert neardup.lost(0.75) <= 8.4e-6 and neardup.lost(0.80) < 1e-7
    rng = np.random.default_rng(5)
    same = (rng.random((100_000, neardup.ENTRIES)) < 0.75).cumsum(1)
    assert not np.any([same[:, upto - 1] < need for upto, need in neardup.needed_matches()], axis=0).sum() > 6


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 100), (5, 5), (7, 6)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), common.Workspace(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}


# ---- classifiers -----------------------------------------------------------------------------------------------


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best segment (longest for ties at its ends is avoided by
    taking the shortest), then left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or (total, -(b - a)) > (best[2] + 1e-12, -(best[1] - best[0]))):
                best = (a, b, total)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1 :])]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        scores = [-0.1 if rng.random() < 0.6 else rng.choice([0.05, 0.3, 1.7, 2.3]) + rng.random() / 50 for _ in range(rng.randint(1, 22))]
        at = [k for k, s in enumerate(scores) if s > 0]
        got = toxicity.segments(at, [scores[k] for k in at])
        assert [(a, b, round(s, 9)) for a, b, s in got] == [(a, b, round(s, 9)) for a, b, s in brute_segments(scores)]


def labelled_corpus(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(1200):
        toxic, poor = k % 6 == 0, k % 5 == 1
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vile,", "Scum", "idiot!"])
        if poor:
            text = [rng.choice(words)] * 60 if rng.random() < 0.5 else [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text) + ".", "en", "s", 0))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "scum " * 20_000, "en", "s", 0), (None, "x", "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("statistics", F.lit(1)).withColumn("y", F.lit(0)), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, empty):
    docs, labels = labelled_corpus(spark)
    truth = {r.doc_id: r for r in labels.where("doc_id is not null and quality is not null").collect()}
    tox = toxicity.fit(docs, labels)
    found = toxicity.score(docs, tox)
    good = quality.fit(docs, labels)
    scores = {"toxic": ({r.doc_id: r.score for r in found.collect()}, 0.5), "quality": ({r.doc_id: r.score for r in quality.score(docs, good).collect()}, 0.3)}
    for name, (got, limit) in scores.items():
        held = [k for k in truth if common.held_out(k)]
        assert len(held) > 150 and sum((got[k] >= limit) == bool(truth[k][name]) for k in held) / len(held) > 0.95
        assert set(got) == {*truth, 5000, 5001, 5002, None} and all(0 <= s <= 1 for s in got.values())
    assert found.where("doc_id = 5002").first().score > 0.9
    assert set(tox.lexicon) == {b"vile", b"scum", b"idiot"}
    kept = toxicity.keep_clean(docs, tox)
    assert kept.columns == docs.columns and kept.where("doc_id = 5002").count() == 0 and kept.where("doc_id = 5000").count() == 1
    kept = quality.keep_good(docs, good)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    nothing = labels.where("false")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, nothing)).collect()} == {1 / (1 + np.exp(30))}
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, nothing)).collect()} == {1.0}
    assert toxicity.score(empty, tox).count() == 0 and quality.score(empty, good).count() == 0


def test_toxicity_ignores_the_order_of_rows(spark):
    docs, labels = labelled_corpus(spark)
    again = docs.orderBy(F.desc("text")).repartition(7)
    one, other = (toxicity.fit(d, labels) for d in (docs, again))
    assert one.lexicon and one.lexicon == other.lexicon
    assert np.allclose([one.rate, one.k, one.intercept, one.slope], [other.rate, other.k, other.intercept, other.slope])


def test_toxicity_score_equals_a_plain_computation(spark):
    """Word scores, segments, calibration and statistic computed word by word from the formulas."""
    docs, labels = labelled_corpus(spark)
    model = toxicity.fit(docs, labels)
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    learned = [(i, t, y[i]) for i, t in rows if i in y and not common.held_out(i)]
    strip = lambda t: [w.strip(toxicity.EDGES) for w in common.words(t)]
    counted: dict = {}
    for _, t, label in learned:
        mark = int(common.batch_shingles(pa.array([t]))[0].min().view(np.int64)) if common.words(t) else 0
        counted[mark, label] = min(counted.get((mark, label), t), t)
    y1, y0 = Counter(), Counter()
    for (_, label), t in counted.items():
        (y1 if label else y0).update(set(strip(t)))
    n1, n0 = sum(y1.values()), sum(y0.values())
    want = {}
    for w in {*y1, *y0} - {b""}:
        prior = (y1[w] + y0[w]) * toxicity.PRIOR * n1 / (n1 + n0)
        odds = lambda k, n, p=prior: np.log((k + p) / (n + toxicity.PRIOR * n1 - k - p))
        score = odds(y1[w], n1) - odds(y0[w], n0)
        if score > 0 and score / np.sqrt(1 / (y1[w] + prior) + 1 / (y0[w] + prior)) >= toxicity.MIN_Z:
            want[w] = score
    assert model.lexicon.keys() == want.keys() and all(abs(model.lexicon[w] - v) < 1e-9 for w, v in want.items())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t in rows[:120]:
        scores = [want.get(w, -toxicity.DRIFT) for w in strip(t)]
        kept = [(a, b, s) for a, b, s in brute_segments(scores) if model.k * len(scores) * np.exp(-model.rate * s) <= toxicity.E_VALUE]
        x = sum(1 - np.log(model.k * len(scores) * np.exp(-model.rate * s) / toxicity.E_VALUE) for *_, s in kept)
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.log1p(x), -30, 30)))) < 1e-9
        assert sorted((z["first"], z["last"]) for z in got[i].segments) == sorted((a, b) for a, b, _ in kept)


def test_rules_are_what_they_say(spark):
    """Trees against exhaustive splits, every row's margin against its paths, the lasso against its conditions, and the
    compiled column against a plain evaluation."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, len(quality.STATISTICS))).round(2)
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (x[:, 5] > 1.2)).astype(float)
    y[rng.random(600) < 0.05] = 0
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = np.full(600, y.mean())
    g, h, rules, step = p - y, p * (1 - p), set(), np.zeros(600)
    quality._grow(binned, cuts, g, h, np.arange(0, 600, 2), np.arange(600), (), rules, step, 1)
    (j, _, k) = next(iter(rules))[0]
    own = np.arange(0, 600, 2)
    gains = {}
    for a in range(x.shape[1]):
        for b in range(len(cuts[a])):
            low, high = own[binned[own, a] <= b], own[binned[own, a] > b]
            if h[low].sum() >= 1 and h[high].sum() >= 1:
                gains[a, b] = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
    assert abs(gains[j, k] - max(gains.values())) < 1e-9
    for side in (binned[:, j] <= k, binned[:, j] > k):  # rows outside the subsample move like those in it
        rows = own[side[own]]
        assert np.allclose(step[side], -g[rows].sum() / (h[rows].sum() + 1))
    a = (rng.random((600, 30)) < 0.4).astype(np.float32)
    a -= a.mean(0)
    w, b = quality._lasso(a, y)
    slope = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert np.all(np.abs(slope[w == 0]) <= quality.PENALTY + 1e-4) and np.allclose(slope[w != 0], -quality.PENALTY * np.sign(w[w != 0]), atol=1e-4)
    model = quality.fit_rules(x, y)
    assert model.rules
    frame = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in frame.select(model.column()).collect()]
    at = {s: k for k, s in enumerate(quality.STATISTICS)}
    want = [model.intercept + sum(v for v, when in model.rules if all((row[at[n]] > c) == above for n, above, c in when)) for row in x.tolist()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-np.array(want)))))
    assert ((np.array(want) > 0) == (y > 0)).mean() > 0.9


def test_below(spark):
    for cuts in ([], [5], [1, 3, 3, 9], list(range(0, 200, 7))):
        got = [r.n for r in spark.range(-2, 210).select(common.below(F.col("id"), cuts).alias("n")).collect()]
        assert got == [sum(c < v for c in cuts) for v in range(-2, 210)]
    assert spark.range(1).select(common.below(F.lit(None).cast("bigint"), [1, 2]).alias("n")).first().n == 0


def test_held_out_rule(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", common.held_out_column("id").alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}


def test_statistics_of_slices_and_empty_texts():
    column = pa.array([t for t in TEXTS[:200]] + [None, "", "\n\n"])
    whole = quality.statistics(column)
    parts = np.concatenate([quality.statistics(column.slice(0, 77)), quality.statistics(column.slice(77))])
    assert np.array_equal(whole, parts) and np.isfinite(whole).all()


# ---- decontamination -------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_texts_left(spark, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(700)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    items = [(k, f"{sentence(rng.randint(8, 30))} {sentence(6)}") for k in range(60)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "zz")]
    rows, want = [], set()
    for k in range(400):
        text = sentence(rng.randint(0, 900)).split()
        for i, t in rng.sample(items[:60], rng.choice([0, 0, 1, 2])):
            text += (t.upper() if rng.random() < 0.3 else t).split() + sentence(rng.choice([1, 40, 300])).split()
            want.add((k, i))
            if i == 0:
                want.add((k, 100))
        rows.append((k, "\n".join(text), "en", "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, items[5][1].rpartition(". ")[0], "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    # every pair by looking for the whole item in the text
    joined = {k: b" " + b" ".join(decontaminate.bare(w) for w in common.words(t or "")) + b" " for k, t, *_ in rows}
    brute = {(k, i) for k, t in joined.items() for i, item in items if item and b" " + b" ".join(decontaminate.bare(w) for w in common.words(item)) + b" " in t}
    assert want <= brute
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == brute
    left = decontaminate.keep_uncontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, *_ in rows} - {k for k, _ in brute}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_retrieval_equals_exhaustive_scores(monkeypatch):
    rng = random.Random(6)
    words = [f"t{k}" for k in range(80)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 15)))) for k in range(50)]
    index = decontaminate.Index.build(items)
    windows = [sorted({index.vocabulary[w.encode()] for w in rng.sample(words, rng.randint(1, 40)) if w.encode() in index.vocabulary}) for _ in range(60)]
    w = np.repeat(np.arange(60), [len(x) for x in windows])
    t = np.array([y for x in windows for y in x])
    got = {(a, b): round(s, 9) for a, b, s in zip(*(x.tolist() for x in index.retrieve(w, t, 0.35)), strict=True)}
    want = {}
    for k, x in enumerate(windows):
        scores = defaultdict(float)
        for term in x:
            for j in range(index.starts[term], index.starts[term + 1]):
                scores[int(index.item[j])] += float(index.impact[j])
        want.update({(k, i): round(s, 9) for i, s in scores.items() if s >= 0.35})
    assert got == want and got


def indexes(spark, bench):
    return [x for group in decontaminate.rounds(bench, common.Workspace(spark, "t")) for x in group]


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(n))
    items = [(k, text(rng.randint(4, 70))) for k in range(120)] + [(200, None), (201, " "), (None, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [" ".join(w if rng.random() < 0.8 else "zz" for w in rng.choice(items[:120])[1].split()) + " " + text(60) for _ in range(150)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(150)), "text": docs})
    one = indexes(spark, bench)
    want = sorted(r for p in one for r in decontaminate.find(batch, p))
    assert len(one) == 1 and want and sorted(decontaminate.find(batch, decontaminate.Index.build(items[:120]))) == want
    monkeypatch.setattr(decontaminate, "SHARD", 9)
    many = indexes(spark, bench)
    assert len(many) > 5 and sum(len(p.items) for p in many) == 120
    assert sorted(r for p in many for r in decontaminate.find(batch, p)) == want
    monkeypatch.setattr(decontaminate, "SENT", 30_000)  # several rounds
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert len(list(decontaminate.rounds(bench, common.Workspace(spark, "t")))) > 1
    assert sorted(map(tuple, decontaminate.contaminated(frame, bench).collect())) == want
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(frame, bench).collect()} == set(range(150)) - {r[0] for r in want}


def test_a_long_item_widens_no_other_passage(spark):
    rng = random.Random(12)
    words = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    long, short = words("l", 3000), words("s", 12)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    scattered = [w for k, x in enumerate(short) for w in (x, *words(f"f{k}_", 200))]
    docs = [" ".join(scattered), " ".join(words("a", 300) + short + words("b", 50)), " ".join(words("c", 500) + long + words("d", 9)), " ".join(rng.sample(long, 900))]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(len(x.items) for x in indexes(spark, bench)) == [1, 1]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()} == {(1, 2), (2, 1)}


def test_item_words_are_the_same_in_columns_and_python(spark):
    texts = ["What's  \tthe (answer)?\n42!", "--- a-b ÉCOLE \x0b x\x0cy", "\u00a0q \u2003z", "", "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", decontaminate._own_words(F.col("text")).alias("w")).orderBy("k").collect()
    assert [r.w for r in rows] == [[decontaminate.bare(w).decode() for w in common.words(t)] for t in texts]


def test_a_full_store_keeps_what_is_asked_for_again():
    asked = []

    def encode(strings):
        asked.extend(strings)
        return np.array([ord(c) for x in strings for c in x], np.uint32), np.array([len(x) for x in strings], np.int64)

    store = chunks.Store(encode, 4)
    for strings in (["a", "bb", "c"], ["bb", "dd", "a", "bb", "e"], ["e", "bb", "a", "dd"], list("vwxyz"), ["z", "a", "v", "a"]):
        starts, sizes, flat = store.runs(strings)
        assert ["".join(map(chr, flat[a : a + n])) for a, n in zip(starts, sizes, strict=True)] == strings
    assert asked == ["a", "bb", "c", "dd", "e", *"vwxyz", "a"]


def test_words_of_all_slices_are_looked_up_together():
    coder = wavelet.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    asked = []
    real = coder._encoder._parts.runs
    coder._encoder._parts.runs = lambda strings: asked.append(len(strings)) or real(strings)
    texts = pa.array(["one two three", None, " two  words \n x", "", "l'été two", "a <|endoftext|> b one", "  ", "three two one"])
    found = list(coder.encode_slices(texts, [0, 3, 3, 6, 8]))
    assert len(asked) == 1
    library = coder._whole
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [counts.tolist() for _, counts in found] == [[len(x) for x in want[a:b]] for a, b in ((0, 3), (3, 3), (3, 6), (6, 8))]
    assert [k for flat, _ in found for k in flat.tolist()] == [k for x in want for k in x]


# ---- search ----------------------------------------------------------------------------------------------------


def brute_search(rows, queries, k):
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in vectors:
        if q in queries:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for k in range(300)]
    rows += [(300 + k, rows[20][1]) for k in range(90)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (405, [1e13] * 8), (406, [1.0, 2.0]), (420, [3.0, -1.0]), (None, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in sorted(vafile.top_k(frame, frame.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = {q: v for q, v in brute_search(rows, {k for k in range(0, 421, 20)}, 20).items() if v}
    assert dict(got) == want
    assert vafile.top_k(frame.where("false"), frame.where("false")).count() == 0


def test_search_of_repeated_ids_and_huge_vectors(spark, monkeypatch):
    """Each row of a repeated query id has a list of its own; scores beyond a long are the nearest long."""
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 1, 4).tolist()) for k in range(60)] + [(20, [9.0, 0.0, 0.0, 0.0]), (20, [0.0, 9.0, 0.0, 0.0]), (21, [5.0, 5.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = defaultdict(list)
    for r in vafile.top_k(frame, frame.where("vec_id = 20"), 5).collect():
        lists[r["rank"]].append((r.vec_id, r.score))
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = [sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != 20)[:5] for q, a in ints if q == 20]
    for rank in range(1, 6):
        assert sorted(lists[rank]) == sorted((w[rank - 1][1], -w[rank - 1][0]) for w in want)
    huge = spark.createDataFrame([(0, [1e12] * 8), (1, [1e12] * 8), (2, [-1e12] * 8), (3, [0.0] * 8), (4, [1e307] * 8), (5, [1.0] * 8)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in vafile.top_k(huge, huge.where("vec_id = 0"), 9).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 5, 8 * 64 * 64 * 10**12), (3, 3, 0), (4, 2, -(2**63))]


def test_copies_beyond_the_best_are_left_out():
    x = np.array([[1.0], [1.0], [2.0], [1.0], [1.0], [1.0], [2.0], [1.0]])
    assert vafile._few_copies(np.array([1, 1, 1, 1, 2, 3, 4, 5]), x, 2).tolist() == [0, 1, 2, 4, 5, 6]


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The bounds leave a small part of the pairs to be read exactly."""
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 500)
    read = []
    real = vafile._scores
    monkeypatch.setattr(vafile, "_scores", lambda pairs, *rest: read.append(pairs.count()) or real(pairs, *rest))
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(k, rng.normal(0, 0.2, 16).tolist()) for k in range(2000)], "vec_id long, embedding array<double>")
    assert vafile.top_k(frame, frame.where("vec_id % 100 = 0")).count() == 400
    assert read[0] == 400 and sum(read) < 20 * 2000 * 0.05


def test_search_sends_no_rows_through_the_driver(spark, monkeypatch):
    """No plan broadcasts, and candidates don't grow with the number of blocks."""
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 10)
    plans, left = [], []
    real = vafile.Workspace.write

    def write(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = real(self, df, label)
        left.append((label, out.count()))
        return out

    monkeypatch.setattr(vafile.Workspace, "write", write)
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 0.2, 16).tolist()) for k in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = vafile.top_k(frame, frame.where("vec_id % 20 = 0"))
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute_search(rows, set(range(0, 4000, 20)), 20)
    assert not [p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()] if "Broadcast" in p]
    assert dict(left)["bounds"] < 200 * 20 * 4  # 80 blocks


def test_search_gives_away_what_it_can_not_hold(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 30)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 4)
    monkeypatch.setattr(vafile, "GROUP", 2)
    monkeypatch.setattr(vafile, "HELD", 100)
    rng = np.random.default_rng(9)
    rows = [(k, [0.5] * 4 if k % 3 else rng.normal(0, 0.2, 4).tolist()) for k in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vafile.top_k(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == brute_search(rows, set(range(0, 600, 20)), 20)


# ---- pages -----------------------------------------------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><ul>{menu}</ul></nav><div class="ad">Buy</div>'
    '<div class="cookie-notice">We use</div><article><h1>Title &amp; more</h1><p><b>Bold start<br><p>Second&nbsp;&#8211;  para\n here</p>{body}<form><label>x</label></form></article><aside>Side</aside><div id="comments"><p>First!</p></div><footer>&copy; x'
)


def page(menu=3, paragraphs=2):
    return PAGE.format(menu="".join(f"<li><a href=/{k}>m{k}</a></li>" for k in range(menu)), body="".join(f"<p>para {k}</p>" for k in range(paragraphs)))


def test_main_text(spark):
    rows = [(k, f"https://a.test/{k}", page(k % 5, k % 4)) for k in range(40)] + [(50, "https://b.test/", "<body><nav>m</nav><div class=post-body><p>Only text<p>and more</div><footer>f"), (51, None, "<p>plain"), (52, "bad url", None), (53, "https://a.test/x", ""), (1, "https://a.test/1", page(1, 1))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))
    got = defaultdict(list)
    for r in wrappers.main_text(frame).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for k in range(40):
        want = "\n\n".join(["Title & more", "Bold start", "Second – para here", *[f"para {j}" for j in range(k % 4)]])
        assert got[k] == [want] * (2 if k == 1 else 1)
    assert got[50] == ["Only text\n\nand more"] and got[51] == ["plain"] and got[52] == [""] and got[53] == [""]
    assert wrappers.main_text(frame.where("false")).count() == 0


def test_wrapper_covers_all_structures():
    streams = [wrappers.fold(tuple(wrappers.blocks(page(m, p))[0])) for m in range(5) for p in range(4)]
    wrapper = wrappers.infer([(s, 1) for s in streams])
    flat = list(wrappers._symbols(wrapper))
    for s in streams:
        rest = iter(flat * 3)
        assert all(x in flat for x in wrappers._symbols(s)) and all(x in rest for x in wrappers._symbols(s))
    assert any(isinstance(n, tuple) and n[2] for n in wrapper) and any(isinstance(n, tuple) and n[1] for n in wrapper)


def test_fold_and_align():
    assert wrappers.fold(("<li", "#", ">li", "<li", "#", ">li")) == ((("<li", "#", ">li"), False, True),)
    a, b = ("<p", "#", ">p"), ("<p", "#", ">p", "<hr", ">hr")
    assert wrappers.align(a, b) == ("<p", "#", ">p", (("<hr", ">hr"), True, False)) == wrappers.align(b, a)
    many, once = wrappers.fold(a + a + a), a
    assert wrappers.align(many, once) == many


def read_all(spark, pages):
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.main_text(frame).collect()}


def story(k, n=3):
    return "".join(f"<p>story {k} part {j}</p>" for j in range(n))


def test_template_slots_are_told_from_varying_ones(spark, monkeypatch):
    """A text that a host repeats on all pages is dropped by its slot, though it stands in the article."""
    different = [("https://a.test/", f"<article><h1>t{k}</h1>{story(k, 2 + k % 3)}<h2>Notes</h2><p>note {k}<div><h2>Join</h2><blockquote>Write to us</blockquote></div></article>") for k in range(8)]
    copies = [("https://b.test/", f"<nav>m{k}</nav><article><h1>same</h1>{story(0)}<div>Write to us</div></article>") for k in range(8)]
    near = [("https://c.test/", f"<nav>m{k}</nav><article><h1>same</h1>{story(0, 40)}<div>edit {k}</div></article>") for k in range(8)]
    pages = different + copies + near
    got = read_all(spark, pages)
    for k in range(8):
        assert got[k] == "\n\n".join([f"t{k}", *[f"story {k} part {j}" for j in range(2 + k % 3)], "Notes", f"note {k}"])
        assert got[8 + k] == "\n\n".join(["same", *[f"story 0 part {j}" for j in range(3)], "Write to us"])
        assert got[16 + k] == "\n\n".join(["same", *[f"story 0 part {j}" for j in range(40)], f"edit {k}"])
    monkeypatch.setattr(wrappers, "SMALL", 0)  # dealt by host
    assert read_all(spark, pages) == got


def test_every_page_matches_its_wrapper():
    rng = random.Random(8)

    def part(depth):
        name = rng.choice(["div", "ul", "section", "p", "article"])
        return f"<{name}>" + "".join(part(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["x", "<hr>", "<p>y</p>"]) for _ in range(rng.randint(0, 4))) + f"</{name}>"

    for _ in range(60):
        pages = [part(3) + part(2) for _ in range(6)]
        wrapper = wrappers.infer([(wrappers.fold(tuple(wrappers.blocks(p)[0])), 1) for p in pages])
        reader = wrappers.Reader(wrappers._pack(wrapper))
        for p in pages:
            slots, texts = reader.place(p)
            assert len(slots) == len(texts) and ["#" + "\x1f".join(reader.paths[s]) for s in slots] == [x if x != "#" else "#" for x in wrappers.blocks(p)[0] if x[0] == "#"]


def test_names_do_not_drop_the_content(spark):
    """An element that encloses the content stays whatever it is named, and so do headings and sections inside."""
    inner = '<h1 class="entry-header">T{0}</h1><p>a{0} and more</p><h2 id="discussion">Discussion</h2><p id="search">b{0}</p><section id="related-work"><p>c{0}</p></section><div class="share">Tweet {0}</div><section class="comments"><p>First {0}</p></section>'
    shapes = ['<body class="x"><div class="layout has-sidebar"><article>{}</article><div class="sidebar"><article>teaser</article></div></div>', '<div class="page no-sidebar"><main>{}</main></div>', '<form id="f"><div class="page no-sidebar"><div class="post">{}</div></div></form>', '<div class="page no-sidebar">{}</div><div class="sidebar"><div class="text">teaser</div></div>']
    pages = [(f"https://h{n}.test/{k}", shape.format(inner.format(k))) for n, shape in enumerate(shapes) for k in range(2)]
    got = read_all(spark, pages)
    for k in range(len(pages)):
        assert got[k] == "\n\n".join(x.format(k % 2) for x in ["T{}", "a{} and more", "Discussion", "b{}", "c{}"]), pages[k]


def test_awkward_markup(spark):
    """Quotes in unquoted values, hidden inline elements, names that only look like boilerplate's, unclosed tags."""
    cases = {
        "<article><p data-x=it's>first</p><p>second don't stop</p><p>third</p></article>": "first\n\nsecond don't stop\n\nthird",
        '<article><div class="side-effects">kept</div><p class="share-price">price</p><p class="search">found</p></article>': "kept\n\nprice\n\nfound",
        '<article><div class="share-box">gone</div><div class="ad-slot-3">gone</div><div id="commentsArea">gone</div><p>kept</p></article>': "kept",
        '<article><p>one <span hidden>not <span>this</span> nor that</span> two <span class="advert">buy</span>three</p><p>four</p></article>': "one two three\n\nfour",
        "<article><p>one <b aria-hidden=true>gone <p>two</p></article>": "one\n\ntwo",
        '<article><p title="a > b">x &amp; y</p><p title=\'"\'>z</p></article><p': "x & y\n\nz",
        "<article><a href=/a/>linked</a> text</article>": "linked text",
    }
    pages = [(f"http://h{k}.example/", h) for k, h in enumerate(cases)]
    assert read_all(spark, pages) == dict(enumerate(cases.values()))


def test_long_groups_fold():
    """A list whose items have more than 24 symbols folds, whatever their number."""
    item = ("<li", *[x for k in range(15) for x in (f"<i{k}", "#", f">i{k}")], ">li")
    for n in (2, 3, 40):
        assert wrappers.fold(("<ul", *item * n, ">ul")) == ("<ul", (item, False, True), ">ul")
    rng = random.Random(2)
    for _ in range(200):
        own = [x for _ in range(rng.randint(0, 14)) for x in rng.choice([("<a", ">a"), ("#",), ("<b", "#", ">b"), ("<a", "#", ">a")])]
        assert wrappers.Automaton(wrappers.fold(tuple(own))).match(own) is not None


def test_wrapper_in_parts_covers_all(spark, monkeypatch):
    """Structures aligned in parts, whose expressions are aligned again; without alignment most pages have no place."""
    monkeypatch.setattr(wrappers, "PART", 3)
    pages = [(10 * m + p, "http://many.example/x", page(m, p)) for m in range(8) for p in range(1, 5)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    work = common.Workspace(spark, "t")
    found = wrappers.wrappers(frame.withColumn("host", wrappers.host()).select("host", "html"), work).collect()
    assert [r.host for r in found] == ["many.example"]
    reader = wrappers.Reader(found[0].wrapper)
    assert all(reader.place(h)[1] == wrappers.blocks(h)[1] for _, _, h in pages)
    alone = wrappers.Reader(wrappers._pack(wrappers.fold(tuple(wrappers.blocks(pages[0][2])[0]))))
    with pytest.raises(ValueError, match="covered"):
        for _, _, h in pages:
            alone.place(h)


def test_long_streams_are_aligned(spark, monkeypatch):
    """Alignment by halves finds as much in common as the whole table does; long pages take part in their wrapper."""
    rng = random.Random(2)
    for cells in (1 << 28, 64):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(200):
            x, y = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in "xy")
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(len(x)):
                for j in range(len(y)):
                    best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
            pairs = wrappers.common(x, y)
            assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    monkeypatch.undo()
    body = lambda seed: "".join(f"<{t}>{t} text</{t}>" for t in random.Random(seed).choices(["p", "h2", "h3", "pre", "dl", "blockquote"], k=2500))
    pages = [("https://a.test/1", "<main><p>short</p></main>")] + [(f"https://a.test/{k}", f"<main><p>outside</p><article>{body(k)}</article></main>") for k in (2, 3)]
    got = read_all(spark, pages)
    assert got[0] == "short" and all("outside" not in got[k] and len(got[k].split("\n\n")) == 2500 for k in (1, 2))


# ---- revisits --------------------------------------------------------------------------------------------------


def test_revisits_equal_brute_force(spark):
    rng = random.Random(1)
    kind = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, digest string"
    rows = []
    for k in range(600):
        url = rng.choice(["http://A.test:80/x?b=2&a=1&utm_source=q#f", "http://a.test/x?a=1&b=2", "https://b.test", "https://b.test:443/", "junk", None]) if rng.random() < 0.9 else f"http://c.test/{k % 7}"
        status = rng.choice([200, 304, 304, 404])
        rows.append((k, url, rng.randint(0, 120) if k % 97 else None, status, rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "d1", "d2"]), rng.choice([None, {"ETag": '"9"', "Content-Length": "5", "X-A": str(k)}, {"x-a": "q", "X-A": "p", "Date": "t"}]), f"g{k}"))
    frame = spark.createDataFrame(rows, kind).withColumn("found", F.lit(1)).repartition(4)
    canon = {r.url: r.c for r in frame.select("url", revisits.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    assert canon["http://A.test:80/x?b=2&a=1&utm_source=q#f"] == canon["http://a.test/x?a=1&b=2"] == "http://a.test/x?a=1&b=2" and canon["https://b.test"] == canon["https://b.test:443/"] == "https://b.test/"
    lower = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
    want = {}
    for r in rows:
        if r[3] != 304:
            continue
        earlier = [o for o in rows if o[3] == 200 and r[1] is not None and o[1] is not None and canon[o[1]] == canon[r[1]] and r[2] is not None and o[2] is not None and o[2] < r[2]]
        o = max(earlier, key=lambda o: (o[2], o[0]), default=None)
        bare = lambda e: e.removeprefix("W/")
        if o is None:
            outcome = "missing"
        elif r[4] is not None and o[4] is not None:
            outcome = "resolved" if bare(r[4]) == bare(o[4]) else "mismatch"
        elif r[5] is not None and o[5] is not None:
            outcome = "resolved" if r[5] == o[5] else "mismatch"
        else:
            outcome = "unverified"
        headers = {**lower(o[6]), **{k: v for k, v in lower(r[6]).items() if k not in revisits.FIXED}} if outcome == "resolved" else None
        want[r[0]] = (o[0] if o else None, outcome, headers, o[7] if outcome == "resolved" else None)
    for ranges in (1, 4, 50):
        got = {r.record_id: (r.refers_to, r.outcome, r.headers, r.digest) for r in revisits.resolve(frame, ranges).collect()}
        assert got == want
    assert revisits.resolve(frame.where("false")).count() == 0


def _peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_worker_memory_of_one_slice():
    """What a worker holds beside 4 MB of text, in MB: passages of common words (decontamination), new pieces (byte BPE)."""
    rng = random.Random(5)
    common_words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    items = [(k, " ".join(rng.sample(common_words, 30)) + ". " + " ".join(rng.sample(common_words, 6))) for k in range(400)]
    index = decontaminate.Index.build(items)
    rows = [" ".join(rng.choices(common_words, k=570)) for _ in range(1000)]
    rows[7] += " " + items[3][1]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": pa.array(rows, pa.string())})
    found = []
    assert _peak(lambda: found.extend(decontaminate.find(batch, index))) < 500  # 1,992 before, 320 now
    assert (7, 3) in {r[:2] for r in found}
    coder = bpe.Bpe.from_file(P.path(bpe.RANKS_FILE), P.PATTERN)
    pieces = ["".join(rng.choices("etaoinshrdlu", k=8)).encode() for _ in range(150_000)]
    got = []
    assert _peak(lambda: got.extend(coder.replay(pieces))) < 85  # 111 before, 66 now
    assert coder.decode(got[0])[0] == b"".join(pieces)
    assert _peak(lambda: coder.decode(got[0])) < 15  # 24 before, 8 now
