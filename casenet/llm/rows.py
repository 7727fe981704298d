"""Numbers for rows, where ids repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casenet.plans.shared import SharedTables


def numbered(docs: DataFrame, tables: SharedTables) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``__row``, which is the doc_id unless different texts share it, and the other numbers (__number, __id) if there are any.

    Of those, the text of the least hash keeps the id and the others get numbers
    above all ids, so equal rows have equal numbers; a null id stays null.
    """
    rows = docs.withColumn("__row", F.col("doc_id").cast("bigint"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__hash")).where("__id is not null")
    ids = named.groupBy("__id").agg(F.min("__hash").alias("first"), F.max("__hash").alias("last"))
    mixed = tables.write(ids.where("first < last").select("__id", "first"), "mixed")
    if mixed.isEmpty():
        return rows, None
    above = named.agg(F.max("__id")).first()[0] + 1
    others = named.join(mixed, "__id").where("__hash <> first").select("__id", "__hash").distinct()
    others = tables.write(others.withColumn("__number", F.monotonically_increasing_id() + above), "numbered")
    tagged = rows.withColumn("__text", F.xxhash64("text")).join(others, (F.col("__row") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    return tagged.withColumn("__row", F.coalesce("__number", "__row")).drop("__text", "__id", "__hash", "__number"), others.select("__number", "__id")
