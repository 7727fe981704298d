"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a bucketed table, sorted by digest within each bucket. A batch is
reduced to one row for each digest before anything is shuffled twice and joined
to the index by a sort-merge join that leaves the index side in place; a
sort-merge anti-join finds what is new. The append comes last, when the verdict
is written: a failure before it leaves the index as it was, and a batch that is
given again under its name is judged as at first and adds nothing.

Edge cases: a null text counts as empty, and empty texts are equal to each
other; a text of any length is hashed whole; of equal texts in one batch the
smallest doc_id stays (null ids come last, and of several null ids one row); a
text that the index holds from another batch is dropped in favour of the row
that the index names, unless it is that row (same id) come again; rows that
repeat both id and text are judged alike; an empty batch appends nothing; only
the id and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casenet.plans.shared import SharedTables, delete, new_path

INDEX_SCHEMA = "digest binary, keep_id bigint, n_seen bigint, batch string"
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 16, 1 << 15


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold about ``rows`` digests: about 500,000 of them, 30 MB, in each sort."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space, as 32 bytes.

    The outer coalesce tells Catalyst that it is never null: a join on it would
    otherwise get a null test below the projection, which hashes each text again.
    """
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.coalesce(F.unhex(F.sha2(plain.cast("binary"), 256)), F.lit(b""))


class DigestIndex:
    """A digest table bucketed and sorted by hash, kept at ``path`` under the catalog name ``table``.

    It has one row for each digest and batch: the row that stays, and how many
    rows of that text the batch held.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "digest-index"), buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all batches; the bucketing spares the shuffle."""
        return self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n_seen").alias("group_size"))

    def append(self, rows: DataFrame) -> None:
        """Add rows; each bucket is one file of each append."""
        rows.select("digest", "keep_id", "n_seen", "batch").repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the catalog name; the files stay and can be opened again by their path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def delete(self) -> None:
        """Close the index and delete its files."""
        self.close()
        delete(self.spark, self.path)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"))


def _report(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Rows (doc_id, digest) with the verdict of their group (digest, keep_id, group_size)."""
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *more)


def look_up(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of rows that the index holds, over all its batches."""
    return judge(digests(docs), index)


def judge(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``look_up`` for rows (doc_id, digest) that are hashed already.

    The groups become a plain table first: beside a bucketed one, the rows of a
    digest that very many texts share could not be split over tasks.
    """
    return _report(rows, SharedTables(rows.sparkSession).write(index.groups(), "groups"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Judge a batch against ``index``, then append it, and return one row for each document.

    Columns: doc_id, keep_id, group_size (rows of that text in this batch and in
    earlier ones), kept, text_sha256, is_new (no other batch of the index has the
    text). ``batch`` names the batch, so that a replay of it is recognised.
    """
    name = batch or uuid.uuid4().hex
    tables = SharedTables(docs.sparkSession)
    rows = tables.write(digests(docs), "digests")
    groups = tables.write(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_seen")), "groups")
    others = index.read().where(F.col("batch") != name).groupBy("digest").agg(F.min("keep_id").alias("known_id"), F.sum("n_seen").alias("n_known"), F.lit(True).alias("known"))
    seen = groups.join(others.hint("merge"), "digest", "left").select(
        "digest", "n_seen", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"), (F.col("n_seen") + F.coalesce("n_known", F.lit(0))).alias("group_size"), F.col("known").isNull().alias("is_new")
    )
    seen = tables.write(seen, "seen")
    # A null id names no row, so a row without id stays only where the text is new.
    verdict = _report(rows, seen, "is_new").withColumn("kept", F.col("kept") & (F.col("is_new") | F.col("doc_id").isNotNull()))
    verdict = tables.write(verdict, "verdict")
    own = index.read().where(F.col("batch") == name).select("digest")
    index.append(seen.join(own.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(name)))
    tables.drop("digests", "groups", "seen")
    return verdict


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows equal in id and text one stays, the least by text and then by the others as JSON.

    A row is known by its id and digest, for different texts may share an id or have none.
    """
    own = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs.count()))
    judged = deduplicate(docs, own, batch).select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__of"), "kept")
    if index is None:
        own.delete()
    rows = docs.withColumn("__digest", text_digest(F.col("text")))
    same = F.col("__digest").eqNullSafe(F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = rows.join(judged.where(~F.col("kept")).select("__id", "__of").distinct(), same, "left_anti")
    twice = judged.where("kept").groupBy("__id", "__of").count().where("count > 1").select("__id", "__of")
    once = kept.join(twice, same, "left_anti").drop("__digest")
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))  # an order for columns of any type
    again = kept.join(twice, same, "left_semi").groupBy("doc_id", "__digest").agg(F.min_by(F.struct(*docs.columns), F.struct("text", rest)).alias("row"))
    return once.unionByName(again.select("row.*"))
