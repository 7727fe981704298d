"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Shingles are placed by a first permutation; one stored second permutation,
read with circular shifts, then gives all coordinates of a signature. Because
consecutive shifts are consecutive table entries, the coordinates of a shingle
are one contiguous read. Documents with equal shingle sets form one class and
only its first member goes on. Bands name candidate pairs; a link needs the
exact Jaccard similarity of the full sets.

Bands hold hot groups, so a band never yields all its pairs. In linear rounds
each document is compared with one pivot of its bands; what is linked is one
component from then on, and only bands that still hold several components are
looked at again. Crowded bands, of more than ``CROWD`` members beside their
largest component, take further rounds with pivots among the open components
for as long as these become an eighth fewer each time. Members that are left
are sketched and compared in blocks of at most ``BLOCK``; those of a band's
largest component do not meet each other. Members of crowded bands meet on
their rarest shingles instead, which miss no pair. Members of a band are
spread over ``SALTS`` tasks, and a pivot's set is copied for every ``PARTNERS``
members of its bands.

Edge cases: null, empty and blank texts have an empty set and are linked with
nothing; a text with fewer words than a shingle has its whole sequence as one
shingle; a text of any length is taken whole, as one set in one row; a null
doc_id is returned unlinked with a null component; in ``near_duplicates`` rows
that share a doc_id share its verdict, while ``keep_one`` tells different texts
of one id apart; repeated rows fall into one class; a tie for a pivot or for
the row that stays goes to the smallest doc_id; an empty table gives an empty
result; only the id and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casenet.llm import textkernel as tk
from casenet.llm.rows import numbered
from casenet.plans.components import connected_components
from casenet.plans.shared import SharedTables

UNIVERSE_BITS = 22
LINEAR_ROUNDS = 2
SKETCH, BLOCK = 512, 512
CROWD = 2 * BLOCK  # open members of a band; texts of one form just below the similarity pass the sketches, so what a band may bring to the exact comparison is half the square of this
SALTS, PARTNERS = 16, 256
SLOT_BITS = 18  # of the counters that order shingles by their frequency: 2 MB, whatever the input


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a chunk: documents (ascending) and hashes."""
    words = tk.words(tk.LOWER_ASCII[data], offsets)
    start = tk.whole_windows(words.first, size)
    doc, value = words.doc[start], tk.ngrams(words.hash, size)[start] if len(start) else np.zeros(0, dtype=tk.U64)
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = np.array([tk.ngrams(words.hash[words.first[d] : words.first[d + 1]], int(n_words[d]))[0] for d in short], dtype=tk.U64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


@lru_cache(maxsize=2)
def _shifted(n_coordinates: int) -> np.ndarray:
    """Row i holds the second permutation at places i, i + 1, ... (circular): coordinate k is its shift by k."""
    ring = np.random.default_rng(577215664).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: n_coordinates - 1]]), n_coordinates)


def signatures(doc: np.ndarray, value: np.ndarray, n_docs: int, n_coordinates: int) -> np.ndarray:
    """Circulant MinHash signature of each document (largest value where the set is empty)."""
    place = (tk.mix(value ^ tk.U64(0x5851F42D4C957F2D)) >> tk.U64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full((n_docs, n_coordinates), np.iinfo(np.uint32).max, dtype=np.uint32)
    shifted = _shifted(n_coordinates)
    step = max(256, (1 << 20) // n_coordinates)
    for lo in range(0, len(doc), step):
        part = doc[lo : lo + step]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        low = np.minimum.reduceat(shifted[place[lo : lo + step]], first, axis=0)
        out[part[first]] = np.minimum(out[part[first]], low)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(tk.U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=tk.U64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = tk.mix(key * tk.U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def signature_table(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                doc, value = shingles(data, offsets, size)
                n = np.bincount(doc, minlength=hi - lo)
                some = np.flatnonzero(n)
                first = np.searchsorted(doc, some)
                digests = np.zeros((2, hi - lo), dtype=tk.U64)
                if len(some):
                    digests[0, some] = np.add.reduceat(tk.mix(value), first)
                    digests[1, some] = np.bitwise_xor.reduceat(tk.mix(value ^ tk.U64(0x2545F4914F6CDD1D)), first)
                keys = band_keys(signatures(doc, value, hi - lo, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), _signed(digests[0]), _signed(digests[1]), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its whole shingle set as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                doc, value = shingles(data, offsets, size)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets = [value[cut[d] : cut[d + 1]].tobytes() for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id bigint, items binary")


def _sketches(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id and a sketch of its set: the band keys and the low bytes of ``SKETCH`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = []
            for items in batch.column("items"):
                value = np.frombuffer(items.as_buffer(), dtype=tk.U64)
                wide = signatures(np.zeros(len(value), dtype=np.int64), value, 1, max(SKETCH, bands * rows))
                sketches.append(band_keys(wide[:, : bands * rows], bands, rows).tobytes() + wide[0, :SKETCH].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sketches, pa.binary())], names=["doc_id", "sketch"])

    return sets.select("doc_id", "items").mapInArrow(run, "doc_id bigint, sketch binary")


def _spread(members: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``members`` joined to ``table``, which has one row for each ``key``; a hot key's members are dealt over ``SALTS`` tasks."""
    salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], how).drop("salt")


def _with_idle(parts: DataFrame, key: str) -> DataFrame:
    """``parts`` with ``idle`` rows, which need not meet each other, and their number: a part's largest component, where it has more than ``BLOCK`` rows."""
    large = parts.where(F.col("rows") > BLOCK).groupBy(key, "component").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > BLOCK)
    largest = large.groupBy(key).agg(F.max(F.struct("of", "component")).alias("m")).select(key, F.col("m.of").alias("idle_rows"), F.col("m.component").alias("largest"))
    marked = _spread(parts, largest, key, "left").withColumn("idle", F.coalesce(F.col("component") == F.col("largest"), F.lit(False)))
    return marked.withColumn("idle_rows", F.coalesce("idle_rows", F.lit(0))).drop("largest")


def _crowded() -> Column:
    return F.col("rows") - F.col("idle_rows") > CROWD


def _rare_parts(members: DataFrame, sets: DataFrame, percent: int, tables: SharedTables) -> DataFrame:
    """Members once for each of their rarest shingles, as parts in which every pair of the similarity meets at least once.

    A pair has at least ``2 * percent / (100 + percent)`` of the smaller set in
    common and ``percent / 100`` of the larger. In any common order of shingles
    the pair therefore shares one of the first that are left over, and one, of
    each (prefix filtering). The order is by frequency, so that these are what
    a crowd does not have in common. Shingles of a set that only count where
    the other is smaller make it ``idle`` there. The counters are as many for
    every input, so the driver and each task can hold them.
    """

    def slots(values: np.ndarray) -> np.ndarray:
        return (tk.mix(values ^ tk.U64(0x9E6C63D0876A68E5)) >> tk.U64(64 - SLOT_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for items in batch.column("items"):
                np.add.at(total, slots(np.frombuffer(items.as_buffer(), dtype=tk.U64)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    held = tables.write(members.join(sets.select("doc_id", "items"), "doc_id").select("doc_id", "n", "component", "items"), "crowd")
    counted = held.select("items").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for items in batch.column("items"):
                values = np.frombuffer(items.as_buffer(), dtype=tk.U64)
                n = len(values)
                beside_smaller = n + 1 + (-percent * n) // 100
                beside_larger = n + 1 + (-2 * percent * n) // (100 + percent)
                seen = often[slots(values)]
                order = np.lexsort((values, seen))[:beside_smaller]
                idle = np.arange(len(order)) >= beside_larger
                shared = seen[order] > 1
                kept.append((values[order][shared], idle[shared]))
            if kept:
                own = batch.select(["doc_id", "n", "component"]).take(pa.array(np.repeat(np.arange(len(kept)), [len(v) for v, _ in kept])))
                part, idle = (np.concatenate(c) for c in zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([_signed(part), *own.columns, pa.array(idle)], names=["part", "doc_id", "n", "component", "idle"])

    rows = tables.write(held.mapInArrow(rare, "part bigint, doc_id bigint, n bigint, component bigint, idle boolean"), "rare")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if("idle").alias("idle_rows"), F.min("component").alias("low"), F.max("component").alias("high"))
    return _spread(rows, sizes.where("low < high and idle_rows < rows").select("part", "rows", "idle_rows"), "part")


def _block_pairs(parts: DataFrame, sketches: DataFrame, percent: int, bands: int, once: bool = True) -> DataFrame:
    """Pairs (a < b) of members of one part, of different components, whose sizes and sketches allow the similarity.

    A part of more than ``BLOCK`` members is dealt over blocks by a hash of the
    id, and each two of its blocks meet as one bounded group, but for two
    blocks of idle rows. With ``once`` a pair counts in the first of the bands
    that it shares, so it comes once.
    """
    least = int(SKETCH * percent / 100 - 4.5 * (SKETCH * percent / 100 * (1 - percent / 100)) ** 0.5)
    rows = parts.withColumn("idle_blocks", F.ceil(F.col("idle_rows") / BLOCK).cast("int"))
    rows = rows.withColumn("blocks", F.col("idle_blocks") + F.ceil((F.col("rows") - F.col("idle_rows")) / BLOCK).cast("int"))
    spot = F.xxhash64("doc_id")
    rows = rows.withColumn("own", F.when(F.col("idle"), F.pmod(spot, F.col("idle_blocks"))).otherwise(F.col("idle_blocks") + F.pmod(spot, F.col("blocks") - F.col("idle_blocks"))).cast("int"))
    rows = rows.join(sketches, "doc_id").withColumn("other", F.explode(F.sequence(F.when(F.col("idle"), F.col("idle_blocks")).otherwise(0), F.col("blocks") - 1)))
    met = rows.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "n", "component", "key", "sketch")
    met = met.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high", "own")

    def compare(high, own, doc, n, component, key, sketch) -> list[np.ndarray]:
        names, sketch = sketch[:, : 8 * bands].copy().view(np.int64), sketch[:, 8 * bands :]
        cut = int(np.searchsorted(own, high[0])) if own[0] < own[-1] else 0
        left, right = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
        if not cut and own[0] < high[0]:
            return []
        found = []
        for lo in range(0, len(doc[left]), 64):
            part = slice(lo, lo + 64)
            d, m, c, k, name = doc[left][part], n[left][part], component[left][part], sketch[left][part], names[left][part]
            good = (c[:, None] != component[right]) & (100 * np.minimum(m[:, None], n[right]) >= percent * np.maximum(m[:, None], n[right])) & (d[:, None] != doc[right])
            good &= (d[:, None] < doc[right]) | bool(cut)
            i, j = np.nonzero(good)
            for at in range(0, len(i), 4096):
                x, y = i[at : at + 4096], j[at : at + 4096]
                close = (k[x] == sketch[right][y]).sum(axis=1) >= least
                x, y = x[close], y[close]
                shared = (name[x] == names[right][y]).argmax(axis=1)
                here = (name[x, shared] == key[0]) | (not once)
                x, y = d[x[here]], doc[right][y[here]]
                found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def groups(columns: list[np.ndarray], last: bool) -> list[np.ndarray]:
            nonlocal held
            part, low, high = columns[:3]
            edge = np.flatnonzero((part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            bounds = [0, *edge.tolist(), len(part)]
            done = len(bounds) - 1 if last else len(bounds) - 2
            found = [p for g in range(done) for p in compare(*(c[bounds[g] : bounds[g + 1]] for c in columns[2:]))]
            held = None if last else [c[bounds[done] :] for c in columns]
            return found

        def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if found:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:8]] + [np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH + 8 * bands)]
                columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
                yield from pairs(groups(columns, False))
        if held is not None:
            yield from pairs(groups(held, True))

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _close_pairs(still: DataFrame, sets: DataFrame, percent: int, bands: int, n_rows: int, tables: SharedTables) -> DataFrame:
    """Pairs of members of open bands whose sketches allow the similarity; those of crowded bands meet on rare shingles."""
    sketches = tables.write(_sketches(sets.join(still.select("doc_id").distinct(), "doc_id", "left_semi"), bands, n_rows), "sketches")
    parts = still.select("key", F.col("key").alias("part"), "rows", "doc_id", "n", "component")
    if still.where(F.col("rows") > BLOCK).isEmpty():
        return _block_pairs(parts.withColumns({"idle": F.lit(False), "idle_rows": F.lit(0)}), sketches, percent, bands)
    parts = tables.write(_with_idle(parts, "part"), "parts")
    found = _block_pairs(parts.where(~_crowded()), sketches, percent, bands)
    crowd = parts.where(_crowded()).select("doc_id", "n", "component").distinct()
    if crowd.isEmpty():
        return found
    rare = _rare_parts(crowd, sets, percent, tables).withColumn("key", F.lit(0).cast("bigint"))
    return found.unionByName(_block_pairs(rare, sketches, percent, bands, once=False)).distinct()


def _confirmed(pairs: DataFrame, copies: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, copy) with whether 100 * intersection >= percent * union on the full sets; ``copies`` of the set of ``b`` are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=tk.U64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    if copies is None:
        right = right.withColumn("copy", F.lit(0))
    else:
        right = right.join(copies, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(right, ["b", "copy"])
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _open_bands(members: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Members with their component and the band's number of them (``rows``), of the bands that hold two components or more."""
    if edges is None:
        placed = members.withColumn("component", F.col("doc_id"))
    else:
        placed = members.join(connected_components(edges).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "rows")
    return _spread(placed, several, "key")


def _pivot_pairs(still: DataFrame, tested: DataFrame | None, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each document (a) with the pivot (b) that most of its bands name and that it was not compared with, and how many copies a pivot needs."""
    by = F.lit(0) if turn == 0 else F.xxhash64("doc_id" if turn < LINEAR_ROUNDS else "component", F.lit(turn))
    choice = F.struct(by, "doc_id", "n", "component")
    pivots = still.groupBy("key").agg(F.min(choice).alias("p"), F.count(F.lit(1)).alias("members"))
    pivots = pivots.select("key", F.col("p.doc_id").alias("b"), F.col("p.n").alias("n_b"), F.col("p.component").alias("c"), F.ceil(F.col("members") / PARTNERS).cast("int").alias("copies"))
    near = _spread(still.withColumnRenamed("n", "n_a"), pivots, "key").where("component <> c").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    found = near.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("bands"), F.max("copies").alias("copies"))
    if tested is not None:
        known = tested.select(F.col("a").alias("low"), F.col("b").alias("high"))
        found = found.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(known.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), ["low", "high"], "left_anti")
    best = found.groupBy("a").agg(F.max(F.struct("bands", (-F.col("b")).alias("b"), "copies")).alias("best"))
    pairs = best.select("a", (-F.col("best.b")).alias("b"), F.pmod(F.xxhash64("a"), F.col("best.copies")).cast("int").alias("copy"))
    return pairs, pivots.groupBy("b").agg(F.max("copies").alias("copies"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 28, rows: int = 5) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    A pair at exactly 0.80 shares none of 28 bands of 5 rows with probability
    1.5e-5; for 0.85, 24 bands of 6 rows miss 1.2e-5.
    """
    tables = SharedTables(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = tables.write(signature_table(plain, shingle_words, bands, rows), "signatures")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    classes = tables.write(whole.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = whole.join(classes.select(F.col("first_id").alias("doc_id"), "set_a", "set_b", "n_shingles"), ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi")
    banded = firsts.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    members = tables.write(_spread(banded, shared, "key").distinct(), "members")
    wanted = members.select("doc_id").distinct()
    sets = tables.write(_sets(plain.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), shingle_words).dropDuplicates(["doc_id"]), "sets")

    tested: DataFrame | None = None
    edges: DataFrame | None = None
    turn, crowds = 0, None
    while True:
        still = tables.write(_open_bands(members, edges), "open")
        further = still
        if turn >= LINEAR_ROUNDS:
            further = _with_idle(still.where(F.col("rows") > CROWD), "key").where(_crowded() & ~F.col("idle")).drop("idle", "idle_rows")
            before, crowds = crowds, further.select("key", "component").distinct().count()
        last = turn >= LINEAR_ROUNDS and (crowds == 0 or (before is not None and 8 * crowds > 7 * before))
        if not last:
            pairs, copies = _pivot_pairs(further, tested, turn, percent)
        else:
            pairs, copies = _close_pairs(still, sets, percent, bands, rows, tables).withColumn("copy", F.lit(0)), None
            known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        checked = tables.write(_confirmed(pairs, copies, sets, percent), "tested")
        tested = checked if tested is None else tested.unionByName(checked)
        edges = tested.where("linked").select("a", "b")
        if last or still.isEmpty():
            break
        turn += 1
        tables.drop("open")
    groups = connected_components(edges).withColumnRenamed("node", "first_id")
    named = classes.join(groups, "first_id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "first_id").alias("component_id"))
    placed = signed.drop("keys").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that a near-duplicate of smaller id stands for; their own columns only.

    Where different texts share an id, each of them is a document of its own.
    """
    tables = SharedTables(docs.sparkSession)
    rows, others = numbered(docs, tables)
    judged = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), **options)
    if others is None:
        gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    else:
        judged = judged.where("component_id is not null").select("doc_id", "component_id").distinct()
        judged = tables.write(judged.join(others, F.col("doc_id") == F.col("__number"), "left").select("doc_id", "component_id", F.coalesce("__id", "doc_id").alias("own")), "judged")
        firsts = judged.groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("best"))
        gone = judged.join(firsts, "component_id").where("doc_id <> best.doc_id").select(F.col("doc_id").alias("__gone"))
    return rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").select(*docs.columns)
