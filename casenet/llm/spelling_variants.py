"""Groups of spelling variants by a dictionary of trie-node pairs.

Words are nodes of two tries, one forward and one of the reversed words. A node
has a number that follows from its parent's number and its letter, so every task
numbers the nodes alike and no level of a trie waits for another. A word gives
one pair (prefix node, suffix node) for each letter that it skips, and one for
each gap between letters. Two words that skip a letter at the same pair differ
by a replaced letter; a word that skips one at another word's gap has one letter
more. A pair's words differ in one letter only, so it never holds more of them
than the alphabet has letters, and one. Of equal letters in a row only the last
is skipped against gaps, so each two neighbours meet once. Numbers bring pairs
together; the letters themselves then confirm them, so the result is exact.

A word's form is its most frequent neighbour, where that is ``ratio`` times as
frequent as the word or more. Frequencies grow by ``ratio`` along forms, so
following them ends; it is done by pointer jumping.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty
id where letters are deleted by chance; repeated rows count each for itself; of
neighbours of equal frequency the least in code-point order is the form; texts
and words of any length are taken whole; an empty table gives an empty result;
only doc_id and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casenet.llm import textkernel as tk
from casenet.plans.shared import SharedTables

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # [a-zÀ-ÿ]+ in UTF-8
_LOWER = bytes(tk.LOWER_ASCII)
HELD = 200_000  # different words that a task holds before it hands on their counts
ROWS = 200_000  # pairs in one batch
FORWARD, BACKWARD = tk.U64(0x9E3779B97F4A7C15), tk.U64(0xC2B2AE3D27D4EB4F)


def count_words(docs: DataFrame, least_chars: int = 5, least_count: int = 3, misspell_every: int | None = None) -> DataFrame:
    """word and n: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case, of ``least_chars`` code points and found ``least_count`` times, both at least.

    ``misspell_every`` plants variants: where it divides crc32(``doc_id:word``),
    the word's letter at that number modulo the length is left out.
    """

    def misspelt(word: bytes, h: int) -> bytes:
        letters = word.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(_RUN.findall(text.as_py().translate(_LOWER))) if text.is_valid else {}
                begun = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in found.items():
                    if len(word) >= least_chars:
                        if misspell_every and not (h := zlib.crc32(word, begun)) % misspell_every:
                            word = misspelt(word, h)
                        total[word] += n
                if len(total) > HELD:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.where(F.length("word") >= least_chars).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def node_numbers(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (one row of code points each): the forward node of each prefix and the backward node of each suffix, from 0 letters on."""
    count, size = letters.shape
    prefix, suffix = np.zeros((count, size + 1), dtype=tk.U64), np.zeros((count, size + 1), dtype=tk.U64)
    wide = letters.astype(tk.U64) + tk.U64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            prefix[:, k + 1] = tk.mix(prefix[:, k] * FORWARD + wide[:, k])
            suffix[:, k + 1] = tk.mix(suffix[:, k] * BACKWARD + wide[:, size - 1 - k])
    return prefix, suffix


def node_pairs(words: DataFrame) -> DataFrame:
    """Of words (id, word): prefix_node, suffix_node, id, at, kind (0 a gap, 1 a skipped letter, 2 one that no equal letter follows)."""

    def pairs(ids: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        count, size = letters.shape
        prefix, suffix = node_numbers(letters)
        kind = np.ones((count, size), dtype=np.int8)
        kind[:, -1] = 2
        kind[:, :-1] += letters[:, :-1] != letters[:, 1:]
        a = np.hstack([prefix[:, :-1], prefix])
        b = np.hstack([suffix[:, size - 1 :: -1], suffix[:, ::-1]])
        at = np.broadcast_to(np.concatenate([np.arange(size), np.arange(size + 1)]).astype(np.int32), a.shape)
        kinds = np.hstack([kind, np.zeros((count, size + 1), dtype=np.int8)])
        owner = np.broadcast_to(ids[:, None], a.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel().view(np.int64)), pa.array(b.ravel().view(np.int64)), pa.array(owner.ravel()), pa.array(at.ravel()), pa.array(kinds.ravel())], names=["prefix_node", "suffix_node", "id", "at", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            sizes = np.array([len(w) for w in words])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                step = max(1, ROWS // (2 * int(size) + 1))
                for lo in range(0, len(mine), step):
                    part = mine[lo : lo + step]
                    letters = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), size)
                    yield from pairs(ids[part], letters)

    return words.select("id", "word").mapInArrow(run, "prefix_node bigint, suffix_node bigint, id bigint, at int, kind byte")


def near_words(words: DataFrame) -> DataFrame:
    """Each word (word, n) with each of its neighbours (near, near_n), both ways; ``words``: different words with n."""
    tables = SharedTables(words.sparkSession)
    known = tables.write(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    key = ("prefix_node", "suffix_node")
    together = node_pairs(known.where("word <> ''")).withColumn("together", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("together > 1")
    met = tables.write(together.drop("together").join(known, "id"), "met")
    side = lambda rows, name: rows.select(*key, F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("at").alias(f"{name}_at"))
    skipped, last, gaps = met.where("kind > 0"), met.where("kind = 2"), met.where("kind = 0")
    front = "a_at = b_at and substring(a, 1, a_at) = substring(b, 1, b_at)"
    replaced = side(skipped, "a").join(side(skipped, "b"), list(key)).where(f"a <> b and {front} and substring(a, a_at + 2) = substring(b, b_at + 2)")
    longer = side(last, "a").join(side(gaps, "b"), list(key)).where(f"{front} and substring(a, a_at + 2) = substring(b, b_at + 1)")
    ways = [replaced.select("a", "a_n", "b", "b_n"), longer.select("a", "a_n", "b", "b_n"), longer.select("b", "b_n", "a", "a_n")]
    one, two, three = (way.toDF("word", "n", "near", "near_n") for way in ways)
    return one.unionByName(two).unionByName(three)


def _roots(forms: DataFrame, tables: SharedTables) -> DataFrame:
    """word and root of each word that has a form (word, form)."""
    heads = tables.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = heads.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = tables.write(heads.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        tables.drop("roots", all_but_last=True)
        heads = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return heads


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the different ``words`` (word, n)."""
    tables = SharedTables(words.sparkSession)
    known = tables.write(words.select("word", "n"), "counts")
    best = F.min(F.struct((-F.col("near_n")).alias("turned"), "near")).alias("best")
    near = near_words(known).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = known.join(near, "word", "left").withColumn("form_n", -F.col("best.turned"))
    judged = judged.withColumn("form_n", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n")))
    judged = tables.write(judged.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"), "judged")
    roots = _roots(judged.where("form is not null"), tables)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
