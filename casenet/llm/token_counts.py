"""Token counts of a unigram model by trie-shared dynamic programming.

Texts are cut at ASCII white space into pre-tokens, each with the word-begin
mark in front. Distinct pre-tokens go into a trie; the forward score of a node
(best total of any segmentation of its prefix, and how many pieces that takes)
is computed once and shared by all pre-tokens that pass through it. A terminal
keeps its count, and a document's count is the sum over its pre-tokens.

Piece scores are log probabilities by Zipf's law at the rank that the given
vocabulary file states; a character without a piece falls back to its bytes.
Of segmentations with equal scores the one with fewer pieces counts.

Edge cases: null and empty texts have no tokens; a pre-token beyond ``LONG``
characters is scored on its own outside the trie, whole; repeated rows are
counted alike; an empty table gives an empty result; only the id and ``text``
are read. The trie and the counts are bounded and start anew when full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
LONG = 96
MAX_NODES, MAX_TERMINALS = 400_000, 500_000
TAIL = 3


@lru_cache(maxsize=2)
def piece_scores(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece: -log(rank + 1) - log(sum of 1 / (rank + 1))."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(ordinary, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (k + 1) for k in range(len(ranked))))
    return {model.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(ranked)}


class _Terminals(dict):
    """Pieces of each pre-token (UTF-8) met before; others are counted when asked for."""

    def __init__(self, counter: TrieCounter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8")
        n = self.counter.count(text)
        if len(text) < LONG:
            if len(self) > MAX_TERMINALS:
                self.clear()
            self[word] = n
        return n


class TrieCounter:
    """Counts pieces of pre-tokens over one shared trie."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.ends: dict[str, set[int]] = {}  # lengths beyond ``TAIL`` that a piece with this end has
        for piece in scores:
            if len(piece) > TAIL:
                self.ends.setdefault(piece[-TAIL:], set()).add(len(piece))
        self.moves: dict[str, tuple] = {}
        self.terminal = _Terminals(self)
        self.reset()

    def reset(self) -> None:
        """Start the trie anew; counts of terminals stay, as they do not depend on it."""
        self.child: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def _moves(self, end: str) -> tuple:
        """What the last ``TAIL`` characters (at a word's beginning, all) alone say of the last piece: score and pieces of the last character, scores of two and three characters (or None), and longer lengths that come into question."""
        if len(self.moves) > MAX_TERMINALS:
            self.moves.clear()
        last, get = end[-1], self.scores.get
        width = len(last.encode("utf-8", "surrogatepass"))
        one = get(last)
        first = (width * self.byte, width) if one is None else (one, 1)  # any piece scores above bytes
        found = self.moves[end] = (*first, get(end[-2:]) if len(end) > 1 else None, get(end) if len(end) == TAIL else None, tuple(sorted(self.ends.get(end, ()))))
        return found

    def count(self, word: str) -> int:
        text = MARK + word
        shared = len(text) <= LONG
        if shared and len(self.best) > MAX_NODES:
            self.reset()
        node, best, pieces = 0, [0.0], [0]
        all_best, all_pieces = self.best, self.pieces
        if shared:
            step_of = self.child.get
            for last in text:  # prefixes that are known
                step = step_of(node * 0x110000 + ord(last))
                if step is None:
                    break
                best.append(all_best[step])
                pieces.append(all_pieces[step])
                node = step
        begin, scores, moves = len(best) - 1, self.scores.get, self.moves
        for depth in range(begin + 1, len(text) + 1):  # forward score of text[:depth] from those of its shorter prefixes
            end = text[depth - TAIL : depth] if depth >= TAIL else text[:depth]
            score, more, two, three, longer = moves.get(end) or self._moves(end)
            top, count = best[-1] + score, pieces[-1] + more
            if two is not None:
                score = best[-2] + two
                if score > top or (score == top and pieces[-2] + 1 < count):
                    top, count = score, pieces[-2] + 1
            if three is not None:
                score = best[-3] + three
                if score > top or (score == top and pieces[-3] + 1 < count):
                    top, count = score, pieces[-3] + 1
            for size in longer:
                if size > depth:
                    break
                score = scores(text[depth - size : depth])
                if score is not None:
                    score += best[-size]
                    if score > top or (score == top and pieces[-size] + 1 < count):
                        top, count = score, pieces[-size] + 1
            best.append(top)
            pieces.append(count)
        if shared and begin < len(text):  # what is below a new node is new
            child = self.child
            for step, last in enumerate(text[begin:], len(all_best)):
                child[node * 0x110000 + ord(last)] = step
                node = step
            all_best += best[begin + 1 :]
            all_pieces += pieces[begin + 1 :]
        return pieces[-1]


@lru_cache(maxsize=2)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(piece_scores(path))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each document: doc_id, n_words, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = (text or b"").split()  # bytes are split at ASCII white space only
                words.append(len(found))
                tokens.append(sum(map(counter.terminal.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
