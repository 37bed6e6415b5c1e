"""Token ids as one wavelet-matrix file per shard.

File: ``WMX1``, a length-prefixed JSON header, then compressed sections. Each bit-plane (most significant bit first) is
cut into blocks of ``BLOCK_BITS`` bits that are compressed one by one; a directory keeps each block's place and the
number of ones before it, so that a token, a count over a range or an occurrence is found by reading one block per
plane. Plane k orders the tokens by the bits above k (stably, zeros first), as a wavelet matrix does.

Texts: null and empty give the end id alone. Repeated document ids keep one entry each, in the order of their texts.
Null document ids stand first. An empty table makes no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import Workspace, below, release, sub_batches

MAGIC = b"WMX1"
BLOCK_BITS = 1 << 16
#: Tokens after which a shard's file is closed (at a document's end) and the next one begins.
FILE_TOKENS = 4_000_000
END_ID = 0
SLICE_BYTES = 10_000_000  # of texts whose ids are held together
ARROW_BYTES = 1 << 26  # of texts whose words are looked up together: Spark's own bound of an Arrow batch
CACHE_PARTS = 400_000
FILES = "shard bigint, seq bigint, path string, n_tokens bigint, n_docs bigint"
SCHEMA = "doc_id bigint, shard bigint, seq bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of these ids, which are those of the documents one after another."""
    pack = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    sections: list[bytes] = []
    planes = []
    for k in range(levels - 1, -1, -1):
        if k == 7:
            x = x.astype(np.uint8)  # only the low byte's planes are left
        bits = (x & x.dtype.type(1 << k)).astype(bool)
        packed = np.packbits(bits)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64) if len(packed) else np.empty(0, np.int64)
        blocks = [pack(packed[a : a + BLOCK_BITS // 8].tobytes()) for a in range(0, len(packed), BLOCK_BITS // 8)]
        before = np.concatenate(([0], np.cumsum(ones)))
        planes.append({"zeros": int(len(x) - before[-1]), "sizes": [len(b) for b in blocks], "ones_before": before[:-1].tolist()})
        sections += blocks
        x = np.concatenate((x.take(np.flatnonzero(~bits)), x.take(np.flatnonzero(bits))))  # faster than masks, whose branches can't be foreseen
    missing = [k for k, d in enumerate(doc_ids) if d is None]
    docs = pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    header = pack(json.dumps({"n": len(ids), "docs": len(doc_ids), "null_ids": missing, "docs_size": len(docs), "block_bits": BLOCK_BITS, "planes": planes}).encode())
    return b"".join([MAGIC, struct.pack("<q", len(header)), header, docs, *sections])


class Reader:
    """Access, counts and occurrence lookup from one file's bytes, without unpacking more blocks than asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<q", data, 4)
        self._unpack = zstandard.ZstdDecompressor().decompress
        head = json.loads(self._unpack(data[12 : 12 + size]))
        at = 12 + size
        docs = self._unpack(data[at : at + head["docs_size"]])
        at += head["docs_size"]
        self.n, count = head["n"], head["docs"]
        ids = np.frombuffer(docs, "<i8", count).tolist()
        for k in head["null_ids"]:
            ids[k] = None
        self.doc_ids: list[int | None] = ids
        self.lengths = np.frombuffer(docs, "<i8", count, 8 * count)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.block_bits, self.planes, self._data, self._places = head["block_bits"], head["planes"], data, []
        for p in self.planes:
            places = np.concatenate(([0], np.cumsum(p["sizes"]))).astype(np.int64) + at
            self._places.append(places.tolist())
            at = int(places[-1])
        self._block = functools.lru_cache(maxsize=256)(self._read_block)

    def _read_block(self, level: int, k: int) -> np.ndarray:
        a, b = self._places[level][k : k + 2]
        bits = np.unpackbits(np.frombuffer(self._unpack(self._data[a:b]), np.uint8))
        return np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, self.block_bits)
        p = self.planes[level]
        if k == len(p["sizes"]):
            return self.n - p["zeros"]
        return p["ones_before"][k] + (int(self._block(level, k)[rest]) if rest else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for level, p in enumerate(self.planes):
            before = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - before
            value = value << 1 | bit
            i = p["zeros"] + before if bit else i - before
        return value

    def _run(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among positions start..end stand after the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for level, p in enumerate(self.planes):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = p["zeros"] + a, p["zeros"] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token stands among positions start..end."""
        a, b = self._run(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, j: int) -> int:
        """The position of the token's j-th occurrence (from 0)."""
        a, b = self._run(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for level in range(len(self.planes) - 1, -1, -1):
            p = self.planes[level]
            one = i >= p["zeros"]
            want = i - p["zeros"] if one else i
            low, high = 0, self.n  # the largest position with `want` equal bits before it
            while low < high:
                mid = (low + high + 1) // 2
                ones = self._rank1(level, mid)
                if (ones if one else mid - ones) <= want:
                    low = mid
                else:
                    high = mid - 1
            i = low
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes' stable partitions undone from the last to the first."""
        levels = len(self.planes)
        x = np.zeros(self.n, np.uint8)
        for level in range(len(self.planes) - 1, -1, -1):
            p, places = self.planes[level], self._places[level]
            packed = b"".join(self._unpack(self._data[a:b]) for a, b in zip(places, places[1:]))  # noqa: B905
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            if level == levels - 9:  # the low byte is whole
                x = x.astype(np.uint16 if levels <= 16 else np.uint32)
            out = np.empty_like(x)
            out[np.flatnonzero(~bits)] = x[: p["zeros"]]
            out[np.flatnonzero(bits)] = x[p["zeros"] :] | x.dtype.type(1 << (levels - 1 - level))
            x = out
        return x.astype("<u4")


def _write(root: str, name: str, data: bytes) -> str:
    """Writes a file under its final name in one step, so that a repeated or lost attempt leaves no half file."""
    where, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as f:
        f.write(data)
    where.move(part, f"{path}/{name}")
    return f"{root}/{name}"


def _read(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    with where.open_input_stream(path) as f:
        return f.read()


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (k for k in range(256) if k not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class LibraryEncoder:
    """Ids by the tokenizers library. Its model encodes each distinct piece once; a text that holds the string of one of
    its added tokens is given to it whole."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._model = Tokenizer.from_file(path)
        self._model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # pieces come cut, their bytes as letters
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._letters = _byte_letters()
        vocabulary = self._whole.get_vocab()
        self._size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self._size[k] = len(token)  # one letter a byte
        cut = regex.compile(pattern)
        # where every ASCII token is one piece of the pattern, no merge runs over a border between ASCII pieces: such a
        # part needs no cutting, but for an apostrophe, whose pieces depend on what follows
        back = {ord(v): k for k, v in self._letters.items()}
        ascii_tokens = [t for token in vocabulary if token not in self._added and (t := token.translate(back)).isascii()]
        uncut = all(cut.findall(t) == [t] for t in ascii_tokens if "'" not in t and not t.isspace())
        self._encoder = chunks.Encoder(cut.findall, self._pieces, CACHE_PARTS, uncut)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(pieces)
        if joined.isascii() and joined.isprintable():  # but for the space such bytes are their own letters
            runs, sizes = "\n".join(pieces).replace(" ", self._letters[32]).split("\n"), np.fromiter(map(len, pieces), np.int64, len(pieces))
        else:
            found = [p.encode("utf-8", "surrogatepass") for p in pieces]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            runs = [x.decode("latin1").translate(self._letters) for x in found]
        flat = np.concatenate([np.array(self._model.encode_batch_fast(["\n".join(runs[k : k + 2000])], add_special_tokens=False)[0].ids, np.uint32) for k in range(0, len(runs), 2000)])
        ends = np.searchsorted(np.cumsum(self._size[flat]), np.cumsum(sizes), side="left") + 1
        return flat, np.diff(ends, prepend=0)

    def clear(self) -> None:
        self._encoder.clear()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another and each text's number of ids."""
        return next(self.encode_slices(column, [0, len(column)]))

    def encode_slices(self, column: pa.Array, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for the rows from each cut to the next; the words of all slices are looked up together."""
        column = pc.fill_null(column, "")
        mask = np.zeros(len(column), bool)
        for s in self._added:
            mask |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        found = self._encoder.encode_slices(pc.if_else(pa.array(mask), "", column) if mask.any() else column, cuts)
        for (a, b), (flat, counts) in zip(pairwise(cuts), found, strict=True):
            at = np.flatnonzero(mask[a:b])
            if len(at):
                extra = {k: np.array(e.ids, np.uint32) for k, e in zip(at.tolist(), self._whole.encode_batch_fast(column.take(pa.array(a + at)).to_pylist(), add_special_tokens=False), strict=True)}
                runs = [extra.get(k, x) for k, x in enumerate(np.split(flat, np.cumsum(counts)[:-1]))]
                flat, counts = np.concatenate(runs), np.array([len(x) for x in runs], np.int64)
            yield flat, counts


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


def even_keys(spark, n: int) -> list[int]:
    """n numbers of which hash partitioning into n partitions sends each to another one."""
    rows = spark.range(0, 40 * n + 400, 1, 1).selectExpr("id", f"pmod(hash(id), {n}) p").groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r.id for r in sorted(rows, key=lambda r: r.p)]


def write_shards(docs: DataFrame, tokenizer_path: str, work: Workspace, n_shards: int, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; returns shard, seq, path, n_tokens, n_docs by file.

    Shards are ranges of doc_id at its quantiles (read from that column alone), ``seq`` counts a shard's files.
    Texts are shuffled once, to their shard.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    shares = [k / n_shards for k in range(1, n_shards)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    keys = even_keys(spark, n_shards)
    # the shard is the number of cuts below the id; a shard's key sends it to a partition of its own
    shard = below(F.col("doc_id"), cuts).cast("bigint")
    dealt = docs.withColumn("shard", shard).withColumn("key", F.element_at(F.array(*map(F.lit, keys)), (F.col("shard") + 1).cast("int")).cast("bigint"))
    dealt = dealt.repartition(n_shards, "key").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text").select("shard", "doc_id", "text")
    root = work.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, doc_ids, lengths, n, place = [], [], [], 0, [None, 0]

        def close() -> pa.RecordBatch:
            nonlocal held, doc_ids, lengths, n
            data = build(np.concatenate(held), doc_ids, lengths)
            path = _write(root, f"{place[0]:06d}-{place[1]:06d}.wmx", data)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((place[0], pa.int64()), (place[1], pa.int64()), (path, pa.string()), (n, pa.int64()), (len(doc_ids), pa.int64()))], ["shard", "seq", "path", "n_tokens", "n_docs"])
            held, doc_ids, lengths, n = [], [], [], 0
            place[1] += 1
            return row

        coder = _tokenizer(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in (x for whole in batches for x in sub_batches(whole, "text", ARROW_BYTES)):
            parts = list(sub_batches(batch, "text", SLICE_BYTES))
            cuts = [0, *accumulate(p.num_rows for p in parts)]
            for part, (flat, counts) in zip(parts, coder.encode_slices(batch["text"], cuts), strict=True):
                at = 0
                for s, d, size in zip(part["shard"].to_pylist(), part["doc_id"].to_pylist(), counts.tolist(), strict=True):
                    if held and (s != place[0] or n >= FILE_TOKENS):
                        yield close()
                    if s != place[0]:
                        place = [s, 0]
                    held += (flat[at : at + size], end)
                    at += size
                    doc_ids.append(d)
                    lengths.append(size + 1)
                    n += size + 1
                release()
        if held:
            yield close()
        release()  # the cache stays for the next task of this worker

    return work.write(dealt.mapInArrow(run, FILES), "files")


def read_shards(files: DataFrame, n_shards: int) -> DataFrame:
    """Reads written files back; by document its place in the file, its length and the crc32 of its ids."""
    keys = even_keys(files.sparkSession, n_shards)
    dealt = files.withColumn("key", F.element_at(F.array(*map(F.lit, keys)), (F.col("shard") + 1).cast("int")).cast("bigint")).repartition(n_shards, "key").select("shard", "seq", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r = Reader(_read(row["path"]))
                ids = r.tokens().tobytes()
                bounds = r.starts.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]  # noqa: B905
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.doc_ids, pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array([row["seq"]] * n, pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(r.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "seq", "at", "n_tokens", "ids_crc32"],
                )

    return dealt.mapInArrow(run, SCHEMA)


def token_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the documents' ids as wavelet-matrix files in the shared folder and reads them back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. The start of a file
    is a sum over the files before it: within a shard by a window over its few files, between shards from one total
    per shard, whose number is the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = write_shards(docs, tokenizer_path, Workspace(spark, "wavelet"), n_shards)
    totals, offsets = 0, {}
    for r in sorted(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.shard):
        offsets[r.shard] = totals
        totals += r.n
    from pyspark.sql import Window

    starts = files.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_tokens"))
    shard_start = F.element_at(F.array(*[F.lit(offsets.get(k, 0)).cast("bigint") for k in range(n_shards)]), (F.col("shard") + 1).cast("int"))
    starts = starts.select("shard", "seq", (F.col("before") + shard_start).alias("file_start"))
    read = read_shards(files, n_shards)
    # one row a file on the right: few, and their number is that of the files, which is checked before broadcasting
    right = F.broadcast(starts) if files.count() <= 100_000 else starts
    return read.join(right, ["shard", "seq"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
