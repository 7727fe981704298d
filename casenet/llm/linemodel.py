"""Line features and a two-state linear-chain conditional random field.

State 1 is a bad (boilerplate) line, state 0 a good (content) line. The
feature vector of a line holds its own shape and that of both neighbours.
Labels exist for documents only, so lines get them in two steps: a logistic
line model is fitted on the document's label, then in documents labelled bad
only the lines that this model also calls bad stay bad. The field is fitted on
those sequences by its exact likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casenet.llm import textkernel as tk
from casenet.plans.shared import SharedTables

_UPPER = tk.flags(bytes(range(ord("A"), ord("Z") + 1)))
_LETTER = tk.flags(bytes([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)])) | (np.arange(256) >= 0xC0)
_DIGIT = tk.flags(b"0123456789")
SYMBOL = tk.flags(b"#*$%&|<>")
_BANG = tk.flags(b"!?")
_PIPE = tk.flags(b"|\t")
_STOP = tk.flags(b".!?:;\"')")
OWN, NEAR = 12, (2, 4, 5, 6, 7, 8)
WIDTH = 1 + OWN + 2 * len(NEAR)


@dataclass
class LineTable:
    """Features, length in characters and document of each line of a chunk."""

    x: np.ndarray
    chars: np.ndarray
    first: np.ndarray


def line_table(data: np.ndarray, offsets: np.ndarray, words: tk.Words | None = None) -> LineTable:
    rows = tk.lines(data, offsets)
    words = words or tk.words(data, offsets)
    within = lambda flag: (total := tk.running(flag))[rows.end] - total[rows.start]
    n_words = np.searchsorted(words.start, rows.end) - np.searchsorted(words.start, rows.start)
    chars = within((data & 0xC0) != 0x80)
    latin_upper = np.zeros(len(data), dtype=bool)
    latin_upper[:-1] = (data[:-1] == 0xC3) & (data[1:] < 0x9F) if len(data) else False
    share = lambda count, of: np.minimum(1.0, count / np.maximum(of, 1))
    letters = within(_LETTER[data])
    row_of_word = np.searchsorted(rows.start, words.start, side="right") - 1
    stutter = np.zeros(len(words.start), dtype=bool)
    stutter[1:] = (words.hash[1:] == words.hash[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    stuttered = np.bincount(row_of_word, weights=stutter, minlength=len(rows.start))
    again = tk.repeats_earlier(rows.doc, tk.span_hash(words.data, rows.start, rows.end)) & (n_words > 0)
    last = np.zeros(len(rows.start), dtype=bool)
    if len(data):
        last = (rows.end > rows.start) & _STOP[data[np.maximum(rows.end - 1, 0)]]
    own = np.column_stack([
        np.log1p(n_words) / 4, np.log1p(chars) / 6, share(within(_UPPER[data] | latin_upper), letters), share(within(_DIGIT[data]), chars),
        share(within(SYMBOL[data]), n_words), share(within(_BANG[data]), n_words), share(within(_PIPE[data]), n_words), share(stuttered, n_words - 1),
        again, np.minimum(share(chars, n_words * 20), 1.0), n_words == 0, last,
    ]).astype(np.float32)
    opens = np.zeros(len(own), dtype=bool)
    opens[rows.first[:-1]] = True
    closes = np.zeros(len(own), dtype=bool)
    closes[rows.first[1:] - 1] = True
    before, after = np.zeros((2, len(own), len(NEAR)), dtype=np.float32)
    before[1:] = own[:-1, NEAR]
    before[opens] = 0
    after[:-1] = own[1:, NEAR]
    after[closes] = 0
    return LineTable(np.hstack([np.ones((len(own), 1), dtype=np.float32), own, before, after]), chars, rows.first)


@dataclass
class LineModel:
    """``weight``: of state 1 against state 0; ``step[i, j]``: from state i to j; ``scale``: of the document score."""

    weight: np.ndarray
    step: np.ndarray
    scale: tuple[float, float]

    def score(self, good_share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * good_share, -40, 40)))


BLOCK = 512  # lines that a recursion takes one after the other


def _ranked(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First rows of the parts, longest part first, and how many of them reach each row number."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    alive = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")
    return first[:-1][order], alive.tolist()


def _scan(step: np.ndarray, e: np.ndarray, first: np.ndarray, add: np.ufunc, block: int = BLOCK) -> np.ndarray:
    """``v[t, j] = e[t, j] + add_i(v[t - 1, i] + step[i, j])`` through each document, with ``v = e`` on its first line.

    A longer document is cut into blocks, which are taken through side by side
    for either state before them; then only block ends are chained.
    """
    n_blocks = -(-np.diff(first) // block)
    opens = np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int64)
    number = np.arange(opens[-1]) - np.repeat(opens[:-1], n_blocks)
    cut = np.append(np.repeat(first[:-1], n_blocks) + number * block, first[-1])
    head = (number == 0)[:, None, None]
    begin, alive = _ranked(cut)
    v = np.zeros((len(e), 1 if head.all() else 2, 2))
    start = e[cut[:-1], None, :]
    v[cut[:-1]] = start if head.all() else np.where(head, start, step + start)
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        p = v[at - 1]
        for j in (0, 1):
            v[at, :, j] = add(p[:, :, 0] + step[0, j], p[:, :, 1] + step[1, j]) + e[at, None, j]
    if v.shape[1] == 1:
        return v[:, 0]
    before = np.tile([0.0, -np.inf], (len(head), 1))
    begin, alive = _ranked(opens)
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        end = v[cut[at] - 1] + before[at - 1][:, :, None]
        before[at] = add(end[:, 0], end[:, 1])
    before = np.repeat(before, np.diff(cut), axis=0)
    return add(v[:, 0] + before[:, :1], v[:, 1] + before[:, 1:])


def forward_backward(model_step: np.ndarray, unary: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of state 1 for each line, expected steps (2 x 2) and the log partition sum."""
    e = np.column_stack([np.zeros(len(unary)), unary])
    a = _scan(model_step, e, first, np.logaddexp, block)
    q = _scan(model_step.T, e[::-1], len(e) - first[::-1], np.logaddexp, block)[::-1]  # a line and all after it
    end = first[1:] - 1
    log_z = np.logaddexp(a[end, 0], a[end, 1])
    z = np.repeat(log_z, np.diff(first))
    inner = np.ones(len(unary), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    steps = np.array([[np.exp(a[at - 1, i] + model_step[i, j] + q[at, j] - z[at]).sum() for j in (0, 1)] for i in (0, 1)])
    return np.exp(np.minimum(0, a[:, 1] + q[:, 1] - unary - z)), steps, float(log_z.sum())


def viterbi(model_step: np.ndarray, unary: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The likeliest state of each line, as one path through each document; a tie goes to state 0."""
    best = _scan(model_step, np.column_stack([np.zeros(len(unary)), unary]), first, np.maximum, block)
    # The state of a line by that of the next one: on a document's last line, and wherever both agree, it is settled.
    by = np.zeros((len(unary), 2), dtype=np.int8)
    for j in (0, 1):
        by[:, j] = best[:, 1] + model_step[1, j] > best[:, 0] + model_step[0, j]
    end = first[1:] - 1
    by[end] = (best[end, 1] > best[end, 0])[:, None]
    settled = np.flatnonzero(by[:, 0] == by[:, 1])
    turns = np.concatenate([[0], np.cumsum(by[:, 0] > by[:, 1])])
    at = settled[np.searchsorted(settled, np.arange(len(unary)))]
    return by[at, 0] ^ ((turns[at] - turns[:-1]) & 1).astype(np.int8)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit_lines(x: np.ndarray, chars: np.ndarray, first: np.ndarray, quality: np.ndarray, rounds: int = 60) -> LineModel:
    """Fit on whole documents; with one label only, or none, every line counts as of that label (good if none)."""
    x = x.astype(np.float64)
    if not len(quality) or quality.min() == quality.max():
        all_good = not len(quality) or quality.max() == 1
        weight = np.zeros(WIDTH)
        weight[0] = -4.0 if all_good else 4.0
        return LineModel(weight, np.zeros((2, 2)), (-4.0, 8.0))
    doc = np.repeat(np.arange(len(quality)), np.diff(first))
    bad = (quality[doc] == 0).astype(float)
    line_bad = (x @ _logistic(x, bad) > 0) & (bad == 1)
    none = np.bincount(doc, weights=line_bad, minlength=len(quality)) == 0
    y = (line_bad | ((bad == 1) & none[doc])).astype(float)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = (y[at - 1] * 2 + y[at]).astype(int)
    seen = np.bincount(pair, minlength=4).reshape(2, 2)
    weight, step = _logistic(x, y), np.zeros((2, 2))
    rows = x.T @ y
    m, v = np.zeros((2, WIDTH + 4))
    for k in range(1, rounds + 1):
        p, expected, _ = forward_backward(step, x @ weight, first)
        slope = np.concatenate([rows - x.T @ p - weight, (seen - expected).ravel() - step.ravel()]) / len(y)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        weight, step = weight + move[:WIDTH], step + move[WIDTH:].reshape(2, 2)
    p, _, _ = forward_backward(step, x @ weight, first)
    good = good_share(1 - p, chars, first)
    scale = _logistic(np.column_stack([np.ones(len(good)), good]), (quality == 1).astype(float), 0.1)
    return LineModel(weight, step, (float(scale[0]), max(float(scale[1]), 0.0)))


def good_share(good: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of a document's characters (one more for each line end) that good lines hold."""
    size = chars + 1.0
    return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]) if len(first) > 1 else np.zeros(0)


_SAMPLE = "rank bigint, quality int, n_lines int, chars binary, x binary"


def _sample_rows(batches: Iterator[pa.RecordBatch], max_lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tk.chunks(batch.column("text")):
            table = line_table(data, offsets)
            n = np.diff(table.first)
            cut = [slice(table.first[d], table.first[d + 1]) for d in np.flatnonzero(n <= max_lines)]
            short = pa.array(n <= max_lines)
            mine = [batch.column(c).slice(lo, hi - lo).filter(short) for c in ("rank", "quality")]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(n[n <= max_lines], pa.int32()), pa.array([table.chars[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([table.x[c].tobytes() for c in cut], pa.binary())], names=["rank", "quality", "n_lines", "chars", "x"])


def held_out(doc_id: str = "doc_id"):
    """The fifth of the documents that no model sees; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def one_text(docs: DataFrame, known: DataFrame, *labels: str) -> DataFrame:
    """rank, text and labels of the sampled ids ``known`` (of a stated number); of several texts of one id the one of least hash."""
    mine = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    picked = mine.groupBy("doc_id", *labels).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    return picked.select(F.xxhash64("doc_id").alias("rank"), F.col("t.text").alias("text"), *labels)


def fit_line_model(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 400, max_total_lines: int = 400_000) -> LineModel:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_lines`` lines each, chosen by a hash of the id.

    The sample's line features (not its texts) come to the driver, of at most
    ``max_total_lines`` lines in all: ``WIDTH`` floats each, whatever the corpus holds.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    tables = SharedTables(docs.sparkSession)
    sample = tables.write(one_text(docs, some, "quality").mapInArrow(lambda batches: _sample_rows(batches, max_lines), _SAMPLE), "line-sample")
    sizes = sorted((r["rank"], r["n_lines"]) for r in sample.select("rank", "n_lines").collect())
    fits = np.cumsum([n for _, n in sizes]) <= max_total_lines
    got = sample.where(F.col("rank") <= sizes[int(fits.sum()) - 1][0]).toArrow() if fits.any() else None
    tables.drop("line-sample")
    if got is None:
        return fit_lines(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(1, dtype=np.int64), np.zeros(0))
    got = got.sort_by("rank").combine_chunks()
    joined = lambda name, kind: np.frombuffer(b"".join(v.as_buffer() for v in got[name]), dtype=kind)
    return fit_lines(joined("x", np.float32).reshape(-1, WIDTH), joined("chars", np.int32), np.concatenate([[0], np.cumsum(got["n_lines"].to_numpy())]), got["quality"].to_numpy())
