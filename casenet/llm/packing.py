"""Packing into optimal length buckets.

A histogram of all lengths decides, by dynamic programming, at which lengths
the buckets end so that the total padding is least; every document then joins
batches of at most ``token_budget`` padded tokens inside its bucket.

Edge cases: a null or empty text has length 0 and is a row of padding only; a
text longer than the budget is a batch of its own, never cut; ties in length
are ordered by id, and rows equal in both by a number stored with them; repeated
rows are packed each for itself; an empty table gives an empty result; only the
id and ``text`` (or the given length) are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casenet.plans.shared import SharedTables

def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, n_buckets: int) -> tuple[np.ndarray, int]:
    """Upper ends of at most ``n_buckets`` buckets over ascending ``lengths``, and the padding they leave.

    cost(i, j) = lengths[j] * rows in i..j - tokens in i..j. The best start of the
    last bucket never falls as j rises, so each layer is solved by halving.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, dtype=np.int64), 0
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    best = lengths * rows[1:] - tokens[1:]
    starts: list[np.ndarray] = []
    for _ in range(1, min(n_buckets, n)):
        after, start = best.copy(), np.zeros(n, dtype=np.int64)
        work = [(0, n - 1, 0, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(max(first, 1), min(last, mid) + 1)
            at = 0
            if len(i):
                cost = best[i - 1] + lengths[mid] * (rows[mid + 1] - rows[i]) - (tokens[mid + 1] - tokens[i])
                k = int(cost.argmin())
                if cost[k] < after[mid]:
                    after[mid], at = cost[k], int(i[k])
            start[mid] = at
            work += [(lo, mid - 1, first, max(at, first)), (mid + 1, hi, max(at, first), last)]
        starts.append(start)
        best = after
    ends, j = [], n - 1
    for start in reversed(starts):
        ends.append(j)
        if start[j] == 0:
            break
        j = int(start[j]) - 1
    else:
        ends.append(j)
    return lengths[sorted(set(ends))], int(best[-1])


def pack(docs: DataFrame, length: Column | None = None, n_buckets: int = 16, token_budget: int = 16384, group_rows: int = 20000) -> DataFrame:
    """One row for each document: doc_id, n_tokens, bucket, bucket_tokens, batch_id, row_in_batch, padding.

    ``length`` is in tokens; without one, words are counted. The driver gets one
    histogram row for each different length, of which there are no more than the
    longest text has tokens. Large buckets are dealt by a hash of the stored row
    number over groups of about ``group_rows`` rows, each of which forms its own
    batches, so no bucket and no repeated id meets in one task.
    """
    tables = SharedTables(docs.sparkSession)
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (word_count(F.col("text")) if length is None else length.cast("bigint")).alias("n_tokens"))
    measured = tables.write(measured.withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = measured.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).orderBy("n_tokens").collect()
    lengths, rows = np.array([(r["n_tokens"], r["rows"]) for r in histogram], dtype=np.int64).reshape(-1, 2).T
    ends, _ = boundaries(lengths, rows, lengths * rows, n_buckets)
    bucket_of = np.searchsorted(ends, lengths)
    held = np.bincount(bucket_of, weights=rows, minlength=len(ends)) if len(ends) else []
    plan = [(b, int(e), max(1, token_budget // max(int(e), 1)), max(1, -(-int(held[b]) // group_rows))) for b, e in enumerate(ends)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("bucket_tokens", T.LongType()), T.StructField("batch_rows", T.LongType()), T.StructField("groups", T.LongType())])
    buckets = docs.sparkSession.createDataFrame(plan, schema)
    which = F.array_size(F.filter(F.lit([int(e) for e in ends]) if len(ends) else F.array().cast("array<bigint>"), lambda e: e < F.col("n_tokens")))
    placed = measured.withColumn("bucket", which.cast("int")).join(F.broadcast(buckets), "bucket")
    placed = placed.withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")))
    order = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("n_tokens", "doc_id", "row")) - 1
    placed = placed.withColumn("order", order)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.concat_ws("-", "bucket", "group", F.floor(F.col("order") / F.col("batch_rows")).cast("bigint")).alias("batch_id"),
        (F.col("order") % F.col("batch_rows")).cast("int").alias("row_in_batch"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
