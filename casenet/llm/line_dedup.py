"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without ASCII white space at its ends, A-Z in lower
case; two 64-bit hashes stand for it. A run is a table of keys bucketed and
sorted by hash: the batch that brought the key first, the largest doc_id of
that batch that holds it, and how many documents do. Each new batch becomes one
run: it is reduced to one row for each key, merge-anti-joined with what the
runs have settled (a key in ``least_docs`` documents or more needs no further
count) and added at level 0. ``fanout`` runs of one level are merged into one of
the next. The manifest of live runs is written last, so a failure before it
leaves the runs as they were, and a batch that comes again adds nothing.

A key found in ``least_docs`` documents loses all its lines except those of the
largest doc_id in the first batch that holds it; give batches by descending
doc_id to keep the largest of all.

Edge cases: a null or empty text is one empty line; a line of fewer than
``least_chars`` code points always stays, and so do empty lines and ``\\n`` at
the end of a text; rows that share a doc_id are one document for the count and
each loses its own lines; a row without doc_id counts as no document and never
keeps a repeated line; repeated lines within the document that keeps them all
stay; texts and lines of any length are taken whole; an empty table gives an
empty result; columns besides doc_id and ``text`` are passed on by
``deduplicate`` unless they bear the name of an output column, which then wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casenet.plans.shared import SharedTables, delete, exists, new_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("h1", "h2")
SCHEMA = "h1 bigint, h2 bigint, batch int, keep_id bigint, n_docs bigint"
LINES_PER_BUCKET, MOST_BUCKETS = 500_000, 1 << 15


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; the quick way where the text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def long_lines(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, text_hash, n_lines, place and key hashes (h1, h2) of each line with a key of ``least_chars`` or more; other columns but ``text`` stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *rest, F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("__lines"))
    rows = split.select("doc_id", *rest, "text_hash", F.size("__lines").alias("n_lines"), F.posexplode("__lines").alias("place", "__line")).withColumn("__key", stripped(F.col("__line")))
    rows = rows.where(F.length("__key") >= least_chars).withColumn("__key", lower_ascii(F.col("__key")))
    return rows.select("doc_id", *rest, "text_hash", "n_lines", "place", F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(40503), "__key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of line keys below ``path``; opened again by the path, with the buckets that they were made with."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16, fanout: int = 3, least_docs: int = 3):
        self.spark, self.path, self.buckets, self.fanout, self.least_docs = spark, path or new_path(spark, "line-runs"), buckets, fanout, least_docs
        self.version, self.batches, self.live, self._tables = 0, [], [], {}
        if exists(spark, f"{self.path}/manifest"):
            last = spark.read.schema("version int, buckets int, batches array<string>, live array<struct<level: int, name: string>>").json(f"{self.path}/manifest").orderBy(F.desc("version")).first()
            self.version, self.buckets, self.batches, self.live = last["version"], last["buckets"], list(last["batches"]), [(r["level"], r["name"]) for r in last["live"]]

    def _table(self, name: str) -> str:
        """Catalog name of a run, made anew in a session that does not know it."""
        if name not in self._tables:
            known = f"line_run_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {known} ({SCHEMA}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._tables[name] = known
        return self._tables[name]

    def _commit(self, batches: list[str], live: list[tuple[int, str]]) -> None:
        row = (self.version + 1, self.buckets, batches, live)
        self.spark.createDataFrame([row], "version int, buckets int, batches array<string>, live array<struct<level: int, name: string>>").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.version, self.batches, self.live = self.version + 1, batches, live

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = self._table(name)
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.catalog.refreshTable(table)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._table(name)) for _, name in self.live]

    def add(self, lines: DataFrame, batch: str) -> None:
        """Add the keys of a batch (rows of ``long_lines``) as a run, and merge levels that are full."""
        if batch in self.batches:
            return
        once = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count("doc_id").alias("n_docs"))
        own = once.select(*KEY, F.lit(len(self.batches)).alias("batch"), "keep_id", "n_docs").repartition(self.buckets, *KEY)
        for run in self.runs():
            own = own.join(run.where(F.col("n_docs") >= self.least_docs).select(*KEY).hint("merge"), list(KEY), "left_anti")
        self._commit([*self.batches, batch], [*self.live, (0, self._write(own))])
        level = 0
        while sum(of == level for of, _ in self.live) >= self.fanout:
            self._merge([name for of, name in self.live if of == level], level + 1)
            level += 1

    def _merge(self, names: list[str], level: int) -> None:
        made = self._write(self._summed(names))
        self._commit(self.batches, [*((of, name) for of, name in self.live if name not in names), (level, made)])
        for name in names:
            self._forget(name)
            delete(self.spark, f"{self.path}/{name}")

    def _summed(self, names: list[str]) -> DataFrame:
        """One row for each key: its first batch, what that batch keeps, and all documents counted.

        Runs are read by their paths: a union of bucketed scans claims their
        partitioning, and may then be read unbucketed without a shuffle.
        """
        first = F.min(F.struct("batch", "keep_id")).alias("first")
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{name}" for name in names)).repartition(self.buckets, *KEY)
        return rows.groupBy(*KEY).agg(first, F.sum("n_docs").alias("n_docs")).select(*KEY, "first.batch", "first.keep_id", "n_docs")

    def repeated(self) -> DataFrame:
        """h1, h2 and keep_id of the keys found in ``least_docs`` documents or more."""
        if not self.live:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, keep_id bigint")
        return self._summed([name for _, name in self.live]).where(F.col("n_docs") >= self.least_docs).select(*KEY, "keep_id")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name, 'line_run_none')}")

    def close(self) -> None:
        """Forget the catalog names; the files stay."""
        for name in list(self._tables):
            self._forget(name)

    def delete(self) -> None:
        self.close()
        delete(self.spark, self.path)


def marks(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, text_hash and, in ``places``, the sorted places of the lines that go; no row where all lines stay."""
    gone = lines.join(repeated, list(KEY)).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"), F.max("n_lines").alias("n_lines"))


def without_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped, and ``text`` without the marked lines.

    The places become a binary mask of one byte a line, so that each line looks
    up its own byte, however many lines a text has.
    """
    at = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("places", k - 1))
    until = lambda k: F.when(k < F.size("places"), F.get("places", k)).otherwise(F.col("n_lines"))
    kept_between = F.transform(F.sequence(F.lit(0), F.size("places")), lambda k: F.repeat(F.lit("1"), until(k) - at(k) - 1))
    masks = marked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.size("places").alias("n_dropped"), F.array_join(kept_between, "0").cast("binary").alias("__mask"))
    rows = docs.drop("n_lines", "n_dropped").withColumn("__of", F.xxhash64("text"))
    joined = rows.join(masks, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    stays = F.array_join(F.filter(lines, lambda _, k: F.substring("__mask", k + 1, F.lit(1)) == F.lit(b"1")), "\n")
    out = {"n_lines": F.size(lines).cast("bigint"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("bigint"), "text": F.when(F.col("__mask").isNull(), F.col("text")).otherwise(stays)}
    return joined.withColumns(out).select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


def deduplicate(docs: DataFrame, batches: int = 4, least_chars: int = 20, least_docs: int = 3, fanout: int = 3) -> DataFrame:
    """``docs`` with n_lines, n_dropped and the remaining ``text``; the table goes through fresh runs in ``batches`` by descending doc_id."""
    spark = docs.sparkSession
    tables = SharedTables(spark)
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    low, high = docs.agg(F.min(F.col("doc_id").cast("bigint")), F.max(F.col("doc_id").cast("bigint"))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    part = F.coalesce(F.expr(f"cast((cast({high or 0} as decimal(20, 0)) - cast(doc_id as bigint)) div {width} as int)"), F.lit(batches - 1))
    lines = tables.write(long_lines(rows.select("doc_id", "text", part.alias("part")), least_chars), "lines", "part")
    buckets = min(MOST_BUCKETS, max(16, -(-lines.count() // LINES_PER_BUCKET)))
    runs = LineRuns(spark, buckets=buckets, fanout=fanout, least_docs=least_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("part") == k), f"part-{k}")
    repeated = tables.write(runs.repeated(), "repeated")
    runs.delete()
    return without_marked(rows, tables.write(marks(lines, repeated), "marks"))


def digests(result: DataFrame) -> DataFrame:
    return result.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
