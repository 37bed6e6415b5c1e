"""Byte-level BPE by merge replay over the distinct pieces of many documents at once.

The distinct pieces of all documents that a worker holds at a time (some megabytes of text; pieces met before come from a
cache) form one symbol array with links to the left and right neighbour. An inverted
index maps each mergeable pair's rank to the positions where it stands; ranks are taken in ascending order from a
heap, all positions of a rank merge at once (vectorised), and only the pairs at the touched neighbours are looked up
again and filed under their new rank. The ids equal those of the tiktoken library: within a piece the pair of lowest
rank merges first, of equal ones the leftmost.

Texts: null and empty give no ids; any length is taken whole. Works for any bytes. Null ids and repeated rows each keep a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import chunks
from .common import map_arrow

NONE = np.int32(1 << 30)  # the rank of a pair that doesn't merge
RANKS_FILE = "byte_bpe_50k.tiktoken"
CACHE_PARTS = 200_000
DECODED = 1 << 16  # ids gathered at once; every byte they stand for takes 12 bytes meanwhile
SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        width = max(self.bytes_of) + 1
        size = np.zeros(width, np.int64)
        for rank, token in self.bytes_of.items():
            size[rank] = len(token)
        self.token_starts = np.cumsum(size) - size
        self.token_sizes = size
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(width)), np.uint8)
        self.encoder = chunks.Encoder(self.pattern.findall, self.replay_strings, CACHE_PARTS)
        self.byte_id = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.width = np.int64(width)
        pairs: dict[int, int] = {}
        cautious = np.zeros(width, bool)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * width + b] = rank
                    if rank < a and k > 1:
                        cautious[a] = True
                    if rank < b and len(token) - k > 1:
                        cautious[b] = True
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        #: Ranks whose result may next merge at a lower rank: their positions merge one a piece at a time.
        self.cautious = cautious

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def replay_strings(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.replay([x.encode("utf-8", "surrogatepass") for x in pieces])

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (non-empty bytes) one after another, and each piece's number of ids."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        token = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        place = np.int32 if n < 1 << 31 else np.int64
        piece = np.repeat(np.arange(len(pieces), dtype=place), sizes)
        right = np.arange(1, n + 1, dtype=place)
        left = np.arange(-1, n - 1, dtype=place)
        right[ends - 1] = -1
        left[ends - sizes] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, NONE)  # of the pair that begins at a position
        inner = np.flatnonzero(right >= 0).astype(place)
        rank[inner] = self._rank(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray, ranks: np.ndarray) -> None:
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            bounds = [*starts.tolist(), len(at)]
            for k, r in enumerate(ranks[starts].tolist()):
                group = at[bounds[k] : bounds[k + 1]]
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        there = inner[rank[inner] < NONE]
        file(there, rank[there])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = np.unique(at)
            if self.cautious[r]:
                first = np.r_[True, piece[at[1:]] != piece[at[:-1]]]
                rest, at = at[~first], at[first]
                if len(rest):
                    index[r] = [rest]
                    heapq.heappush(heap, r)
            elif len(at) > 1 and (touching := right[at[:-1]] == at[1:]).any():
                # overlapping occurrences ("aaa"): in each run every second one is merged, from the left
                start = np.flatnonzero(np.r_[True, ~touching])
                run = np.cumsum(np.r_[True, ~touching]) - 1
                at = at[(np.arange(len(at)) - start[run]) % 2 == 0]
            gone = right[at]
            after = right[gone]
            token[at] = r
            right[at] = after
            follows = after >= 0
            left[after[follows]] = at[follows]
            alive[gone] = False
            rank[gone] = NONE
            rank[at] = NONE
            a = at[follows]
            if len(a):
                rank[a] = self._rank(token[a], token[right[a]])
            before = left[at]
            before = before[before >= 0]
            if len(before):
                rank[before] = self._rank(token[before], token[right[before]])
                a = np.concatenate((a, before))
            if len(a):
                ranks = rank[a]
                some = ranks < NONE
                file(a[some], ranks[some])
        kept = np.flatnonzero(alive)
        return token[kept].astype(np.uint32), np.bincount(piece[kept], minlength=len(pieces))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that the ids stand for, and each id's number of bytes."""
        sizes, runs = self.token_sizes[ids], [ids[k : k + DECODED] for k in range(0, len(ids), DECODED)]
        return b"".join(chunks.gather(self.token_starts[x], self.token_sizes[x], self.token_bytes).tobytes() for x in runs), sizes


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> Bpe:
    return Bpe.from_file(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """Every text's ids (little-endian uint32) and the bytes that decoding them gives.

    Returns doc_id, n_tokens, ids, decoded, or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256). One row
    for each row of ``docs``; null texts are empty; nothing is shuffled.
    """

    def make():
        bpe = _coder(ranks_path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = bpe.encoder.encode(batch["text"])
            data, sizes = bpe.decode(ids)
            raw = ids.astype("<u4", copy=False).tobytes()
            ends = np.cumsum(counts)
            byte_ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
            id_runs = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            texts = [data[a:b] for a, b in zip([0, *byte_ends[:-1].tolist()], byte_ends.tolist(), strict=True)]
            n = pa.array(counts, pa.int64())
            if digests:
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (id_runs, texts)]
                return pa.RecordBatch.from_arrays([batch["doc_id"], n, *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            return pa.RecordBatch.from_arrays([batch["doc_id"], n, pa.array(id_runs, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

        work.caches = (bpe.encoder,)
        return work

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, DIGESTS if digests else SCHEMA)
