"""Queries over token ids: unigram counts, byte-level BPE and the wavelet-matrix files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, counts, wavelet
from .common import table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens under a unigram vocabulary."""
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that decoding them gives."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS_FILE), digests=True)


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and crc32, read back from the written files."""
    return wavelet.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_token_counts": op3_token_counts, "op5_byte_bpe": op5_byte_bpe, "op9_wavelet_shards": op9_wavelet_shards}
ORACLES: dict[str, str] = {}
