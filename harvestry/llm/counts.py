"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic programming carries the
best score and its number of tokens, never the path. Tie rules are those of the tokenizers library's Unigram model: of
equal scores the path whose last piece begins first stays; a character without a piece of its own costs the lowest
score less 10; unknown characters count as their UTF-8 bytes where the vocabulary has all byte pieces (else a run of
them is one token). Texts are cut before each space, which becomes the meta symbol in front of every word.

Null and empty texts have no token; a text of any length is counted whole; repeated rows and null ids are kept. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import by_space, distinct
from .common import map_arrow

META = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 800_000
SCHEMA = "doc_id bigint, n_tokens bigint, n_words bigint"


class Counter:
    """Token counts of words, kept for words met before."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int = 0, byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = {p for p, _ in vocabulary}
        self.unknown = vocabulary[unknown_id][0]
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self._known: dict[str, int] = {}

    def clear(self) -> None:
        self._known.clear()

    def _matches(self, text: str) -> list[list[tuple[int, float]]]:
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for end, match in self.automaton.iter(text):
            ends[end + 1].append(match)
        return ends

    def count(self, text: str) -> int:
        """Tokens of one pre-tokenized word (with its meta symbol)."""
        if self.unknown in text or not self.byte_fallback:
            return self._count_by_path(text)
        best, number = [0.0], [0]
        unknown = self.unknown_score
        for end, found in enumerate(self._matches(text)):
            if not end:
                continue
            score = tokens = None
            single = False
            for length, s in sorted(found, reverse=True) if len(found) > 1 else found:  # earlier starts first
                single |= length == 1
                s += best[end - length]
                if score is None or s > score:
                    score, tokens = s, number[end - length] + 1
            if not single and (score is None or unknown + best[-1] > score):
                score, tokens = unknown + best[-1], number[-1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            best.append(score)
            number.append(tokens)
        return number[-1]

    def _count_by_path(self, text: str) -> int:
        """The same by the path itself: where the unknown piece's own string stands there, or there are no byte pieces,
        neighbouring unknown tokens are one."""
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
        for end, found in enumerate(self._matches(text)):
            if not end:
                continue
            held = None
            for length, s in sorted(found, reverse=True):
                if held is None or s + best[end - length][0] > held[0]:
                    held = (s + best[end - length][0], end - length, text[end - length : end] == self.unknown)
            if not any(length == 1 for length, _ in found) and (held is None or self.unknown_score + best[-1][0] > held[0]):
                held = (self.unknown_score + best[-1][0], end - 1, True)
            best.append(held)
        total, end, run = 0, len(text), ""

        def close(run: str) -> int:
            if not run:
                return 0
            return len(run.encode("utf-8", "surrogatepass")) if self.byte_fallback and run not in self.pieces else 1

        while end:
            _, start, unknown = best[end]
            if unknown:
                run = text[start:end] + run
            else:
                total += close(run) + 1
                run = ""
            end = start
        return total + close(run)

    def words(self, found: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = self.count(META + w)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and words of each text."""
        column = pc.fill_null(column, "")
        column = pc.replace_substring(column, META, " ")
        bounds, index, dictionary = distinct(column, by_space)
        each = self.words(dictionary.to_pylist())
        total = np.concatenate(([0], np.cumsum(each[index])))
        tokens, number = np.diff(total[bounds]), np.diff(bounds)
        # a space in front is the first word's meta symbol itself
        lead = pc.starts_with(column, " ").to_numpy(zero_copy_only=False) | (pc.binary_length(column).to_numpy(zero_copy_only=False) == 0)
        if lead.any():
            empty = self.words([""])[0]
            tokens, number = tokens - lead * empty, number - lead
        return tokens, number


@functools.lru_cache(maxsize=2)
def from_sentencepiece(path: str) -> Counter:
    """The pieces and scores that a sentencepiece file holds, as a unigram vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return Counter([(model.id_to_piece(k), model.get_score(k)) for k in range(model.vocab_size())], model.unk_id())


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and n_words of every row; nothing is shuffled."""

    def make():
        counter = from_sentencepiece(vocabulary_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, number = counter.texts(batch["text"])
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(tokens, pa.int64()), pa.array(number, pa.int64())], ["doc_id", "n_tokens", "n_words"])

        work.caches = (counter,)
        return work

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, SCHEMA)
