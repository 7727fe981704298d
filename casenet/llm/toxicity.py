"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; the model of each category sees the
word features and the probabilities of the categories before it. In training
those probabilities are out-of-fold: every row's comes from a model that did
not see the row or one with the same features, as a later model would otherwise
learn to trust fitted labels. The verdict is that of the last category, so it
comes through the whole chain, and its threshold is chosen on out-of-fold
probabilities too.

The label table has one toxic column, so the categories before it say by which
terms a text is toxic. Toxic terms are the selected features of the greatest
lift; those that nearly always stand in the same toxic texts (a word and its
beginnings, words of one phrase) are one family, and the families are dealt to
two sides of about equal frequency. ``first`` and ``second`` are toxic texts that
hold a term of that side: a text may be either or both, so each tells what the
other doesn't.

Features are lower-cased words and their beginnings, hashed; they are counted
over a bounded sample of labelled rows, the most telling ones are selected (in a
tie the lower bucket), and the chain is fitted on them.

Edge cases: null and empty texts have no features and get the base rate; a text
of any length is read whole; repeated rows are scored alike; labels that are
null, not 0/1 or in conflict for one id are ignored; with no label of one kind
nothing is called toxic; an empty table gives an empty result; only the id and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casenet.llm import textkernel as tk
from casenet.llm.linemodel import held_out, one_text
from casenet.plans.shared import SharedTables

BITS, PREFIXES = 20, (4, 5, 6, 8)
CATEGORIES, TOGETHER = ("first", "second", "toxic"), 0.5
_EDGE = tk.flags(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each word and word beginning: its document, its word and its hashed bucket."""
    data = data.copy()
    data[_EDGE[data]] = 0x20
    words = tk.words(data, offsets)
    doc, index, end = words.doc, np.arange(len(words.start)), words.end
    docs, at, bucket = [doc], [index], [words.hash]
    for k, size in enumerate(PREFIXES):
        keep = np.flatnonzero(end - words.start >= size)
        docs.append(doc[keep])
        at.append(keep)
        bucket.append(tk.mix(tk.span_hash(words.data, words.start[keep], words.start[keep] + size) + tk.U64(k + 1)))
    return np.concatenate(docs), np.concatenate(at), (np.concatenate(bucket) >> tk.U64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in tk.chunks(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))):
            doc, _, bucket = features(data, offsets)
            pair = np.unique((doc << BITS) | bucket)
            for label in (0, 1):
                mine = pair[toxic[lo:hi][pair >> BITS] == label] & ((1 << BITS) - 1)
                seen[label] += np.bincount(mine, minlength=1 << BITS)
    at = np.flatnonzero(seen.any(axis=0))
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "n_clean", "n_toxic"])


@dataclass
class ToxicityModel:
    """``column``: of each hashed bucket, -1 if not selected; ``losses``: mean out-of-fold log loss of the verdict without and with the chain."""

    column: np.ndarray
    width: int
    weights: list[np.ndarray]
    threshold: float
    losses: tuple[float, float]


def selected(data: np.ndarray, offsets: np.ndarray, column: np.ndarray) -> np.ndarray:
    """(document, column) pairs of the selected features, each once, in order."""
    doc, _, bucket = features(data, offsets)
    chosen = column[bucket]
    hit = chosen >= 0
    return np.unique(np.column_stack([doc[hit], chosen[hit]]), axis=0) if hit.any() else np.zeros((0, 2), dtype=np.int64)


def sides_of(x: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Side (0 or 1) of each column that is a term, -1 of the others, from the rows ``x`` of toxic texts.

    Terms whose cosine over the rows is above ``TOGETHER`` are one family, and so
    on from term to term; the most frequent family comes first and each goes to
    the side with fewer rows so far (in a tie the first).
    """
    at = np.flatnonzero(term)
    side = np.full(len(term), -1)
    if not len(at):
        return side
    held = x[:, at].astype(np.float64)
    norm = np.sqrt(np.maximum((held * held).sum(axis=0), 1))
    near = (held.T @ held) / norm[:, None] / norm > TOGETHER
    family = np.arange(len(at))
    while True:
        least = np.where(near | np.eye(len(at), dtype=bool), family, len(at)).min(axis=1)
        if (least == family).all():
            break
        family = least
    names = np.unique(family)
    rows = [int(held[:, family == f].any(axis=1).sum()) for f in names]
    load = [0, 0]
    for k in sorted(range(len(names)), key=lambda k: (-rows[k], names[k])):
        to = int(load[1] < load[0])
        side[at[family == names[k]]] = to
        load[to] += rows[k]
    return side


def _design(pairs: np.ndarray, n: int, width: int) -> np.ndarray:
    x = np.zeros((n, width + 1), dtype=np.float32)
    x[:, -1] = 1
    x[pairs[:, 0], pairs[:, 1]] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        w[-1] = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
        return w
    v = np.ones(x.shape[1])
    for _ in range(12):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (0.25 * norm + ridge)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        after = ahead + step * (x.T @ (y - p) - ridge * ahead)
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w


def predict(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of all categories, each model fed with those before it."""
    x, out = x.astype(np.float64), []
    for w in weights:
        p = 1 / (1 + np.exp(-np.clip(np.hstack([*(q[:, None] for q in out), x]) @ w, -30, 30)))
        out.append(p)
    return np.column_stack(out)


def folds_of(pairs: np.ndarray, n: int, folds: int) -> np.ndarray:
    """Fold of each row by a hash of its features, so that rows with the same ones share a fold."""
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=tk.U64)
        np.add.at(total, pairs[:, 0], tk.mix(pairs[:, 1].astype(tk.U64) + tk.U64(1)))
        return (tk.mix(total) % tk.U64(folds)).astype(np.int64)


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One model for each column of ``labels``, fed with the out-of-fold probabilities of those before; and all these probabilities."""
    x, extra, weights = x.astype(np.float64), [], []
    for k in range(labels.shape[1]):
        design = np.hstack([*(q[:, None] for q in extra), x])
        weights.append(fit_logistic(design, labels[:, k]))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            test = fold == f
            out[test] = 1 / (1 + np.exp(-np.clip(design[test] @ fit_logistic(design[~test], labels[~test, k]), -30, 30)))
        extra.append(out)
    return weights, np.column_stack(extra)


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) if len(y) else 0.0


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of thresholds that tell the labels apart best (true less false positive rate); infinite without both labels."""
    if not len(y) or y.min() == y.max():
        return float("inf")
    level = np.unique(p)
    below = lambda label: np.searchsorted(np.sort(p[y == label]), level, side="left") / (y == label).sum()
    gain = np.round(below(0) - below(1), 9)
    floor = np.concatenate([[0.0], level[:-1]])
    best = np.flatnonzero(gain == gain.max())
    widest = best[np.argmax(level[best] - floor[best])]
    return float((level[widest] + floor[widest]) / 2)


def fit(docs: DataFrame, labels: DataFrame, n_features: int = 384, max_docs: int = 8000, threshold: float | None = None, folds: int = 5) -> ToxicityModel:
    """Select features and fit the chain on at most ``max_docs`` labelled documents, chosen by a hash of the id.

    Half of them are toxic where there are enough. Only their ids and labels are
    broadcast, so the texts of the corpus are not shuffled; the driver receives
    ``n_features`` rows of counts and the selected features of the sample.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    take = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    tables = SharedTables(docs.sparkSession)
    some = tables.write(take(1, max_docs // 2).union(take(0, max_docs // 2)), "labelled")
    totals = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    texts = tables.write(one_text(docs, some, "toxic"), "texts").select("text", "toxic")
    counts = texts.mapInArrow(_counts, "bucket bigint, n_clean bigint, n_toxic bigint").groupBy("bucket").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic"))
    lift = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1.0))
    best = counts.withColumn("lift", lift).withColumn("gain", F.col("n_toxic") * F.col("lift")).where("n_toxic >= 3 and lift > 1").orderBy(F.desc("gain"), "bucket").limit(n_features).collect()
    column = np.full(1 << BITS, -1, dtype=np.int16)
    column[[r["bucket"] for r in best]] = np.arange(len(best))
    width = max(len(best), 1)
    term = np.array([r["lift"] > 2.5 for r in best] or [False])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))):
                pairs = selected(data, offsets, column)
                cut = np.searchsorted(pairs[:, 0], np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs[:, 1], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), lists], names=["toxic", "columns"])

    got = texts.mapInArrow(rows, "toxic int, columns array<int>").toArrow().to_pylist()
    tables.drop("labelled", "texts")
    got.sort(key=lambda r: (r["toxic"], r["columns"]))
    pairs = np.array([(i, c) for i, r in enumerate(got) for c in r["columns"]], dtype=np.int64).reshape(-1, 2)
    x, toxic = _design(pairs, len(got), width), np.array([r["toxic"] for r in got], dtype=bool)
    side = sides_of(x[toxic, :width], term)
    y = np.column_stack([*(toxic & (x[:, :width][:, side == k] > 0).any(axis=1) for k in (0, 1)), toxic]).astype(float).reshape(-1, 3)
    fold = folds_of(pairs, len(got), folds)
    weights, unseen = fit_chain(x, y, fold)
    _, alone = fit_chain(x, y[:, -1:], fold)
    losses = (log_loss(alone[:, -1], y[:, -1]), log_loss(unseen[:, -1], y[:, -1]))
    return ToxicityModel(column, width, weights, best_threshold(unseen[:, -1], y[:, -1]) if threshold is None else threshold, losses)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each document: doc_id, held_out, p_first, p_second, p_toxic, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))):
                p = predict(model.weights, _design(selected(data, offsets, model.column), hi - lo, model.width))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array(p[:, -1] >= model.threshold)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    scored = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, p_first double, p_second double, p_toxic double, toxic boolean")
    return scored.select("doc_id", held_out().alias("held_out"), "p_first", "p_second", "p_toxic", "toxic")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
