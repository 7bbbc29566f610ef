"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick enumerates the vocabulary's pieces in a word and dynamic
programming carries the best score and its number of pieces.  Ties go to the
longest last piece, as in the unigram tokenizers, which try starts from the
left and replace a path only by a strictly better one.  No piece of these
vocabularies spans the start of a word, so words are counted alone and
remembered within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Below the lowest score, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers; then it begins anew.
MEMORY = 1 << 20


class Counter:
    """Counts pieces by (piece, score) pairs; unknown characters count as their UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        if any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
            raise ValueError("a piece spans the start of a word")
        alone = "\n" if not any("\n" in piece and len(piece) > 1 for piece, _ in pieces) else ""
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through one word."""
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        reached = 0  # ends up to here are settled
        single = True

        def settle(end: int) -> None:  # characters that no piece ends at, or none alone
            nonlocal reached
            while reached < end:
                reached += 1
                best[reached], count[reached] = best[reached - 1] + self.unknown, count[reached - 1] + len(word[reached - 1].encode())

        at = -1
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at >= 0 and not single:
                    self._single(word, best, count, at)
                settle(last)
                at, single, reached = end, False, end
                best[end] = float("-inf")
            value = best[end - size] + score
            if value > best[end]:
                best[end], count[end] = value, count[end - size] + 1
            single = single or size == 1
        if at >= 0 and not single:
            self._single(word, best, count, at)
        settle(n)
        return count[n], best[n]

    def _single(self, word: str, best: list, count: list, end: int) -> None:
        value = best[end - 1] + self.unknown
        if value > best[end]:
            best[end], count[end] = value, count[end - 1] + len(word[end - 1].encode())

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; a word mark is put before it, none for an empty one."""
        if not text:
            return 0, 0.0
        known, pieces, total = self.known, 0, 0.0
        for word in self.words.findall(MARK + text.replace(" ", MARK)):
            found = known.get(word)
            if found is None:
                if len(known) >= MEMORY:
                    known.clear()
                found = known[word] = self.word(word)
            pieces += found[0]
            total += found[1]
        return pieces, total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """The counter of a vocabulary file: its ordinary pieces with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in ordinary])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, score``.

    ``path`` is a vocabulary file with scores.  Null and empty texts have no
    tokens.  Repeated rows are counted each; other columns are not read.
    Nothing is shuffled.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            found = [count(t.as_py() or "") for t in batch["text"]]
            columns = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64())))], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
