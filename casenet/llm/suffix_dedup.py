"""Repeated passages by a sparse suffix array over words.

Suffixes are retained only at minimisers of the text, so equal passages retain
suffixes at equal places. A suffix's key is the packed codes of its first four
words and, behind them, a hash of its first ``PREFIX`` words; the suffixes are
range-partitioned and sorted by it, and neighbours are compared. A suffix whose
neighbours begin otherwise shares no passage and goes.

From the others, matches are extended left and right. Retained suffixes of one
document that lie one behind the other at the same distance from the same source
(the first place of the suffix: smallest doc_id, then place) are one match as
far as they reach, since two in a row leave no word between their prefixes. Where
such a match ends, and around all other shared suffixes, the suffixes at every
word are sorted and compared in the same way by their first ``min_words`` words;
of a run of equal ones the first is the source. A passage is a union of
overlapping or touching matches. Extending word by word against one neighbour
instead would lose nested passages: where an earlier document holds only the
middle of what two later ones share, it is the neighbour of both.

``SEED`` words make a seed, and of ``MIN_WORDS - PREFIX + 1`` seeds in a row the
least hash is retained (the first one in a tie). Any ``MIN_WORDS`` words in a row
therefore hold a retained suffix with its whole prefix, the same one wherever
they stand, and every passage is found whole.

Repeats within one document count where they begin ``min_words`` words behind
the first place or later, so the first of them stays. Suffixes that come again
in their own document within their own length, as in a text of one repeated
phrase, are one row with a first and a last place.

Edge cases: null, empty and short texts have no passages; a text of any length
is taken whole, in a few arrays of its words; a row with a null doc_id is
neither changed nor a source; in ``repeated_passages`` rows that share a doc_id
count as one document, while ``drop_repeats`` tells different texts of one id
apart; repeated rows are cut alike and are no repeats of each other; ties go to
the smallest doc_id, then the first place; an empty table gives empty results;
other columns are passed through by ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casenet.llm import textkernel as tk
from casenet.llm.rows import numbered
from casenet.plans.shared import SharedTables

SEED, PREFIX, MIN_WORDS = 8, 26, 50
ROWS = "lead bigint, name bigint, doc_id bigint, place int, last int"
_TYPES = {"kind": pa.int32(), "lead": pa.int64(), "name": pa.int64(), "doc_id": pa.int64(), "place": pa.int32(), "last": pa.int32(), "source_id": pa.int64(), "source_place": pa.int32()}


def kept_places(words: tk.Words) -> np.ndarray:
    """Word positions of the minimisers, ascending; texts under ``MIN_WORDS`` words have none."""
    start = tk.whole_windows(words.first, MIN_WORDS)
    if not len(start):
        return start
    view = np.lib.stride_tricks.sliding_window_view(tk.ngrams(words.hash, SEED), MIN_WORDS - PREFIX + 1)
    best = np.concatenate([view[part].argmin(axis=1) + part for part in np.array_split(start, max(1, len(start) // 65536))])
    return np.unique(best)


def suffix_keys(words: tk.Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort key of the suffixes at ``at``: 16 bits of each of the first four words, and a hash of ``width`` words."""
    code = words.hash >> tk.U64(48)
    lead = (code[at] << tk.U64(48)) | (code[at + 1] << tk.U64(32)) | (code[at + 2] << tk.U64(16)) | code[at + 3]
    return lead, tk.ngrams(words.hash, width)[at]


def _rows(ids: pa.Array, words: tk.Words, at: np.ndarray, width: int) -> pa.RecordBatch:
    """Key, document, first and last place of the suffixes at ``at``; equal ones within ``width`` words are one row, which spans less than ``width``."""
    lead, name = suffix_keys(words, at, width)
    doc = words.doc[at]
    order = np.lexsort((at, name, lead, doc))
    at, lead, name, doc = at[order], lead[order], name[order], doc[order]
    chain = np.ones(len(at), dtype=bool)
    chain[1:] = (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1]) | (name[1:] != name[:-1]) | (np.diff(at) > width)
    begin = at[np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))]
    block = (at - begin) // width
    opens = chain.copy()
    opens[1:] |= block[1:] != block[:-1]
    closes = np.append(opens[1:], True)
    first, last, of = at[opens], at[closes], doc[opens]
    signed = lambda v: pa.array(np.ascontiguousarray(v[opens]).view(np.int64))
    place = lambda v: pa.array((v - words.first[of]).astype(np.int32))
    return pa.RecordBatch.from_arrays([signed(lead), signed(name), ids.take(pa.array(of)), place(first), place(last)], names=["lead", "name", "doc_id", "place", "last"])


def suffixes(docs: DataFrame) -> DataFrame:
    """The sparse suffixes of all documents: key, doc_id, first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                words = tk.words(data, offsets)
                at = kept_places(words)
                if len(at):
                    yield _rows(batch.column("doc_id").slice(lo, hi - lo), words, at, PREFIX)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ROWS)


def _compared(rows: DataFrame, with_heads: bool) -> DataFrame:
    """Sort the rows and compare neighbours: those behind the head of their run of equal keys, with the head as their source (kind 0).

    ``with_heads`` gives the heads of runs of several rows too. A run may go on
    in another partition, so the heads of each partition's first and last run
    come besides, as kind 1 where the run has one row there, else as kind 2:
    two rows for a partition at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[np.ndarray] | None = None
        grown, opening = False, True

        def out(kind: int, columns: list[np.ndarray], source: list[np.ndarray]) -> pa.RecordBatch:
            values = [np.full(len(columns[0]), kind), *columns, *source]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _TYPES.values(), strict=True)], names=list(_TYPES))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            lead, name = columns[:2]
            begins = np.ones(n, dtype=bool)
            begins[1:] = (lead[1:] != lead[:-1]) | (name[1:] != name[:-1])
            begins[0] = head is None or lead[0] != head[0][0] or name[0] != head[1][0]
            at = np.flatnonzero(begins)
            several = np.diff(np.append(at, n)) > 1
            of = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            source = [c[np.maximum(of, 0)] for c in columns[2:4]]
            if head is not None:
                for mine, theirs in zip(source, head[2:4], strict=True):
                    mine[of < 0] = theirs[0]
                if not begins[0] and not grown:
                    grown = True
                    if with_heads:
                        yield out(0, head, head[2:4])
                if len(at) and opening:
                    opening = False
                    yield out(1 + grown, head, head[2:4])
            elif len(at) > 1:
                opening = False
                first = [c[:1] for c in columns]
                yield out(1 + int(several[0]), first, first[2:4])
            if not begins.all():
                yield out(0, [c[~begins] for c in columns], [c[~begins] for c in source])
            if with_heads and several.any():
                heads = [c[at[several]] for c in columns]
                yield out(0, heads, heads[2:4])
            if len(at):
                head, grown = [c[at[-1:]] for c in columns], bool(several[-1])
        if head is not None:
            yield out(1 + grown, head, head[2:4])

    ordered = rows.repartitionByRange("lead", "name", "doc_id", "place").sortWithinPartitions("lead", "name", "doc_id", "place", "last")
    return ordered.mapInArrow(run, f"kind int, {ROWS}, source_id bigint, source_place int")


def _sourced(found: DataFrame) -> DataFrame:
    """Rows of ``_compared`` with the head of the whole run as source, and in how many partitions a run has an end (``edges``)."""
    heads = found.where("kind > 0").groupBy("lead", "name").agg(F.min(F.struct("doc_id", "place")).alias("h"), F.count(F.lit(1)).alias("edges"))
    placed = found.join(F.broadcast(heads), ["lead", "name"], "left")
    return placed.withColumns({"source_id": F.coalesce("h.doc_id", "source_id"), "source_place": F.coalesce("h.place", "source_place")})


def shared_suffixes(docs: DataFrame, tables: SharedTables) -> DataFrame:
    """doc_id, place, last, source_id, source_place of every sparse suffix whose prefix stands at another place too, earlier or later."""
    kept = tables.write(suffixes(docs), "suffixes")
    found = tables.write(_compared(kept, with_heads=True), "shared")
    tables.drop("suffixes")
    return _sourced(found).where("kind = 0 or (kind = 1 and edges > 1)").select("doc_id", "place", "last", "source_id", "source_place")


def _chains(doc: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Document, begin, end and source of the matches that suffixes in a row make with one source at one distance.

    Within a document (``own``) the source must lie ``width`` words before.
    """
    away = place - source_place
    use = np.flatnonzero(~own | (away >= width))
    order = use[np.lexsort((place[use], away[use], source[use], doc[use]))]
    doc, place, source, away = doc[order], place[order], source[order], away[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (away[1:] != away[:-1]) | (np.diff(place) > PREFIX)
    closes = np.append(opens[1:], True) if len(order) else opens
    begin, end = place[opens], place[closes] + PREFIX
    long = end - begin >= width
    return doc[opens][long], begin[long], end[long], source[opens][long]


def windows(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Rows like those of ``suffixes``, of ``width`` words, at every word from which these hold an ``asked`` sparse suffix.

    Those inside a match of suffixes in a row are left out, as their source is
    known: the match comes as a row with ``source_id``, from ``place`` to ``last``.
    """

    def marked(first: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        fits = high > low
        steps = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        np.add.at(steps, first[doc[fits]] + low[fits], 1)
        np.add.at(steps, first[doc[fits]] + high[fits], -1)
        return np.cumsum(steps) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                words, spans, ids = tk.words(data, offsets), batch.column("asked").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
                place, last, source, source_place = (pc.struct_field(spans.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                lone = place == last
                known = _chains(doc[lone], place[lone], source[lone], source_place[lone], source[lone] == ids.to_numpy(zero_copy_only=False)[doc[lone]], width)
                wanted = marked(words.first, doc, np.maximum(place - (width - PREFIX), 0), np.minimum(last, np.diff(words.first)[doc] - width) + 1)
                at = np.flatnonzero(wanted & ~marked(words.first, known[0], known[1], known[2] - width + 1))
                if len(at):
                    rows = _rows(ids, words, at, width)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.int64())], names=[*rows.schema.names, "source_id"])
                if len(known[0]):
                    none = pa.nulls(len(known[0]), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, ids.take(pa.array(known[0])), pa.array(known[1], pa.int32()), pa.array(known[2], pa.int32()), pa.array(known[3])], names=["lead", "name", "doc_id", "place", "last", "source_id"])

    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("place", "last", "source_id", "source_place")).alias("asked"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(asked.hint("shuffle_hash"), "doc_id")
    return texts.mapInArrow(run, f"{ROWS}, source_id bigint")


def matches(rows: DataFrame, width: int, tables: SharedTables) -> DataFrame:
    """Begin, end (``s``, ``e``) and source of what stands earlier too, in another document or in their own; the source is the first place."""
    alone = rows.where("source_id is null").drop("source_id")
    found = _sourced(tables.write(_compared(alone, with_heads=False), "neighbours")).where("doc_id <> source_id or place > source_place")
    inner = rows.where("source_id is not null").select("doc_id", F.col("place").alias("s"), F.col("last").alias("e"), "source_id")
    return found.select("doc_id", F.col("place").alias("s"), (F.col("last") + width).alias("e"), "source_id").unionByName(inner)


def _islands(spans: DataFrame) -> DataFrame:
    """Number the groups of overlapping or touching spans (s, e) of each document as ``island``."""
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    opens = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    return spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage of a document that stands earlier too: doc_id, start_word, end_word, n_words, source_id, n_sources, within.

    Positions count words from 0. Each ``min_words`` words (50 or more) in a row
    have as their source the first document that holds them; ``source_id`` is the
    smallest of the passage, ``n_sources`` how many different ones it has, and
    ``within`` says that the document itself is the only one.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"passages under {MIN_WORDS} words aren't indexed")
    tables = SharedTables(docs.sparkSession)
    near = tables.write(windows(docs, shared_suffixes(docs, tables), min_words), "windows")
    tables.drop("shared")
    found = matches(near, min_words, tables).distinct()
    own = F.bool_and(F.col("source_id") == F.col("doc_id")).alias("within")
    spans = _islands(found).groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("source_id").alias("source_id"), F.count_distinct("source_id").alias("n_sources"), own)
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_id", "n_sources", "within")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that stand earlier too; a text left without a word goes, ``n_chars`` is kept true."""
    tables = SharedTables(docs.sparkSession)
    rows, _ = numbered(docs, tables)
    spans = repeated_passages(rows.select(F.col("__row").alias("doc_id"), "text"), min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans"))
    joined = rows.join(spans.hint("shuffle_hash"), rows["__row"] == spans["__id"], "left").drop("__id", "__row")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                spans = batch.column("__spans").slice(lo, hi - lo)
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                words = tk.words(data, offsets)
                stays = np.ones(hi - lo, dtype=bool)
                for d in np.flatnonzero(np.asarray(spans.is_valid())):
                    raw, at = data[offsets[d] : offsets[d + 1]].tobytes(), words.start[words.first[d] : words.first[d + 1]] - offsets[d]
                    pieces, done = [], 0
                    for s, e in sorted((x["start_word"], x["end_word"]) for x in spans[d].as_py()):
                        pieces.append(raw[done : at[s]])
                        done = at[e] if e < len(at) else len(raw)
                    texts[d] = b"".join([*pieces, raw[done:]]).decode()
                    stays[d] = bool(texts[d].strip(" \t\n\r\x0b\x0c"))
                columns = {c: batch.column(c).slice(lo, hi - lo) for c in names}
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, np.asarray(spans.is_valid()), columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(stays))

    return joined.mapInArrow(cut, docs.schema)
