"""Quality rules: counting rules and Viterbi line labels.

The base rules count words, symbols, repeated lines and repeated eight-word
windows. A document that passes them is kept if the share of its characters
in lines that the Viterbi path of the line model marks as content reaches
``content_share``.

Edge cases: a null or empty text has no words and fails the base rules; a text
of any length is read whole; a tie between paths goes to content; repeated rows are judged alike; an empty table gives an empty result; only
the id column and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casenet.llm import textkernel as tk
from casenet.llm.linemodel import SYMBOL, LineModel, fit_line_model, good_share, line_table, viterbi

WINDOW = 8
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_content_lines bigint, n_lines bigint"


def base_counts(data: np.ndarray, offsets: np.ndarray, words: tk.Words) -> dict[str, np.ndarray]:
    """The five base counts of each document of a chunk."""
    n_docs = len(offsets) - 1
    total = tk.running(~tk.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = tk.running(SYMBOL[data])
    rows = tk.lines(data, offsets)
    has_word = np.searchsorted(words.start, rows.end) > np.searchsorted(words.start, rows.start)
    at = np.flatnonzero(has_word)
    line_doc = rows.doc[at]
    again = tk.repeats_earlier(line_doc, tk.span_hash(words.data, rows.start[at], rows.end[at]))
    doc = words.doc
    start = tk.whole_windows(words.first, WINDOW)
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)
    if len(start):
        twice = start[tk.repeated(doc[start], tk.ngrams(words.hash, WINDOW)[start])]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return {
        "n_words": np.diff(words.first), "word_chars": total[offsets[1:]] - total[offsets[:-1]], "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_doc, weights=again, minlength=n_docs).astype(np.int64), "n_repeat_words": np.bincount(doc, weights=inside, minlength=n_docs).astype(np.int64),
    }


def judge(docs: DataFrame, model: LineModel, content_share: float = 0.6, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row for each document: the counts, ``base_failed`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                words = tk.words(data, offsets)
                out = base_counts(data, offsets, words)
                table = line_table(data, offsets, words)
                bad = viterbi(model.step, table.x @ model.weight, table.first)
                share = good_share(1.0 - bad, table.chars, table.first)
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * out["n_words"])
                out |= {"base_failed": failed, "kept": ~failed & (share >= content_share), "content_share": share, "n_content_lines": np.add.reduceat(1 - bad.astype(np.int64), table.first[:-1]), "n_lines": np.diff(table.first)}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def apply_rules(docs: DataFrame, labels: DataFrame, content_share: float = 0.6, max_docs: int = 4000) -> DataFrame:
    """Fit the line model on the labelled documents outside the held-out fifth, then judge every document."""
    return judge(docs, fit_line_model(docs, labels, max_docs), content_share)
