r"""Encoding texts by their distinct parts.

The pattern ``'s|...| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` never lets a piece run over a space that has
a non-space character on either side: before such a space a piece has ended, or after it " x" begins one. So a text
is cut before each space, each distinct part of a batch is tokenized once, and a text's ids are gathered from its
parts' ids. Only a space between two white-space characters (or at an end next to one) is no safe cut; texts that hold
one are handled whole. Splitting, counting and gathering run vectorised over a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BEFORE_SPACE = re.compile(r" (?=\s|\Z)")
_UNSAFE = re.compile(r"(?:(?<=\s)|(?<![\s\S])) (?=\s|\Z)")
#: An ASCII part without apostrophe and white space, so without a piece that depends on its neighbours.
_PLAIN = re.compile(r"[!-&(-~]+").fullmatch


def safe(text: str) -> bool:
    # a space before white space (or the end) is rare; only then look at what stands before it
    return not (_BEFORE_SPACE.search(text) and _UNSAFE.search(text))


def distinct(column: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bounds of each row's words, every word's index among the distinct ones, and these."""
    lists = split(column)
    found = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], found.indices.to_numpy(), found.dictionary


def by_space(column: pa.Array) -> pa.Array:
    return pc.split_pattern(column, " ")


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each row, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - (ends - sizes)).astype(kind), sizes) + np.arange(total, dtype=kind)]


class Store:
    """String -> run of uint32 ids, for strings met before; when full, only those of the last call are kept.

    ``encode`` gives the ids of many strings one after another, and each one's number of ids.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self._encode, self._limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self._at: dict[str, int] = {}
        self._flat, self._starts, self._sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _keep(self, strings: list[str], at: np.ndarray) -> None:
        """Forgets all but these strings' runs, whose places (-1: none) are brought up to date: what is asked for again is
        mostly what was asked for before."""
        found = np.flatnonzero(at >= 0)
        old, first, at[found] = np.unique(at[found], return_index=True, return_inverse=True)
        self._at = dict(zip([strings[k] for k in found[first].tolist()], range(len(old)), strict=True))
        sizes = self._sizes[old]
        self._flat = gather(self._starts[old], sizes, self._flat)
        self._starts, self._sizes = np.cumsum(sizes) - sizes, sizes

    def runs(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and the ids that they point into; a string may stand more than once."""
        at = np.fromiter(map(self._at.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(at < 0)
        if len(self._at) + len(missing) > self._limit:
            self._keep(strings, at)
        if len(missing):
            absent = [strings[k] for k in missing.tolist()]
            new = list(dict.fromkeys(absent))
            flat, sizes = self._encode(new)
            self._starts = np.concatenate((self._starts, np.cumsum(sizes) - sizes + len(self._flat)))
            self._sizes = np.concatenate((self._sizes, sizes))
            self._flat = np.concatenate((self._flat, flat))
            first = len(self._at)
            self._at.update(zip(new, range(first, first + len(new)), strict=True))
            at[missing] = np.arange(first, first + len(new)) if len(new) == len(absent) else np.fromiter(map(self._at.__getitem__, absent), np.int64, len(absent))
        return self._starts[at], self._sizes[at], self._flat


class Encoder:
    """Texts -> ids, given how distinct pieces are encoded and how a string is cut into pieces."""

    def __init__(self, findall: Callable[[str], list[str]], encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int, uncut: bool = False):
        self._findall, self._encode_pieces, self._uncut = findall, encode_pieces, uncut
        self._pieces = Store(encode_pieces, limit)
        self._parts = Store(self._encode_parts, limit)

    def clear(self) -> None:
        self._pieces.clear()
        self._parts.clear()

    def _encode_found(self, pieces: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and the number of ids of each run of ``counts`` pieces."""
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(len(counts), np.int64)
        starts, lengths, flat = self._pieces.runs(pieces)
        total = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        return gather(starts, lengths, flat), total[ends] - total[ends - counts]

    def _encode_alone(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self._findall, strings))
        return self._encode_found([x for pieces in found for x in pieces], np.fromiter(map(len, found), np.int64, len(found)))

    def _encode_parts(self, parts: list[str], mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of strings before each of which a space stands. No piece runs over the border of two such, where a non-space
        follows the space, so they are cut as one text."""
        if self._uncut and mixed:
            plain = [k for k, p in enumerate(parts) if _PLAIN(p)]
            if len(plain) * 2 > len(parts):
                return self._encode_plain(parts, plain)
        text = " " + " ".join(parts)
        if _BEFORE_SPACE.search(text):
            return self._encode_alone([" " + p for p in parts])
        pieces = self._findall(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1), side="right")
        return self._encode_found(pieces, np.diff(upto, prepend=0))

    def _encode_plain(self, parts: list[str], plain: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of which most need no cutting (the places of those are given)."""
        flat, counts = self._encode_pieces([" " + parts[k] for k in plain])
        mask = np.ones(len(parts), bool)
        mask[plain] = False
        other = np.flatnonzero(mask)
        more, others = self._encode_parts([parts[k] for k in other.tolist()], False) if len(other) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        sizes, starts = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        sizes[plain], sizes[other] = counts, others
        starts[plain], starts[other] = np.cumsum(counts) - counts, len(flat) + np.cumsum(others) - others
        return gather(starts, sizes, np.concatenate((flat, more))), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another (uint32) and each row's number of ids; null is the empty text."""
        return next(self.encode_slices(column, [0, len(column)]))

    def encode_slices(self, column: pa.Array, cuts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for the rows from each cut to the next. The words of all slices are looked up together, ids are
        gathered slice by slice."""
        column = pc.fill_null(column, "")
        bounds, index, dictionary = distinct(column, by_space)
        words = dictionary.to_pylist()
        starts, sizes, flat = self._parts.runs(words)
        initials = pc.unique(pc.utf8_slice_codeunits(dictionary, 0, 1)).to_pylist()
        odd = [k for k, w in enumerate(words) if not w or w[0].isspace()] if any(not c or c.isspace() for c in initials) else []
        flag = np.zeros(len(words), bool)
        flag[odd] = True
        for a, b in pairwise(cuts):
            yield self._encode_slice(column.slice(a, b - a), bounds[a : b + 1] - bounds[a], index[bounds[a] : bounds[b]], words, starts, sizes, flat, flag if odd else None)

    def _encode_slice(self, column: pa.Array, bounds: np.ndarray, index: np.ndarray, words: list[str], starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        begin = bounds[:-1]
        firsts = [words[k] for k in index[begin].tolist()]  # no space in front
        per_word = sizes[index]
        first_word = starts[index]
        if odd is not None:  # a space before white space: the rows where that is no safe cut are taken whole
            hit = odd[index]
            hit[begin] = False
            for row in np.unique(np.searchsorted(bounds, np.flatnonzero(hit), side="right") - 1).tolist():
                if not safe(text := column[row].as_py()):
                    firsts[row] = text
                    per_word[bounds[row] : bounds[row + 1]] = 0
        more, counts = self._encode_alone(firsts)
        first_word[begin] = len(flat) + np.cumsum(counts) - counts
        per_word[begin] = counts
        total = np.concatenate(([0], np.cumsum(per_word)))
        return gather(first_word, per_word, np.concatenate((flat, more))), np.diff(total[bounds])
