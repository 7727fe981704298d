"""Reading order of OCR tokens, as one fold per image inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casenet.functions.text import collapse_space

_TOKEN = "struct<cy:double,x1:double,source_index:int,y1:double>"
_LINES = f"array<struct<total:double,tokens:array<{_TOKEN}>>>"


def _place(lines: Column, token: Column, tolerance: Column) -> Column:
    """``lines`` with ``token`` on the nearest line whose running mean is in reach, or on a new one."""
    gap = lambda line: F.abs(line["total"] / F.size(line["tokens"]) - token["cy"])
    reach = F.filter(F.transform(lines, lambda line, i: F.struct(gap(line).alias("gap"), i.alias("i"))), lambda g: g["gap"] <= tolerance)
    nearest = F.array_min(reach)["i"]
    joined = F.transform(lines, lambda line, i: F.when(i == nearest, F.struct((line["total"] + token["cy"]).alias("total"), F.array_append(line["tokens"], token).alias("tokens"))).otherwise(line))
    return F.when(F.size(reach) > 0, joined).otherwise(F.array_append(lines, F.struct(token["cy"].alias("total"), F.array(token).alias("tokens"))))


def reading_order(tokens: DataFrame) -> DataFrame:
    """Add ``line_number`` and ``reconstructed_order`` to each token of an image.

    Tokens are taken by (vertical centre, left edge, index); lines are ordered by
    (mean centre, left edge), tokens in a line by (left edge, top, index). The
    reach of a line is half the median token height, two units at least.
    """
    cy = (F.col("y1") + F.col("y2")) / 2
    token = F.struct(cy.alias("cy"), F.col("x1"), F.col("source_index").cast("int").alias("source_index"), F.col("y1"))
    grouped = tokens.groupBy("image_id").agg(F.array_sort(F.collect_list(token)).alias("ts"), F.greatest(F.lit(2.0), F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)) * 0.5).alias("tolerance"))
    folded = F.aggregate("ts", F.array().cast(_LINES), lambda lines, t: _place(lines, t, F.col("tolerance")))
    keyed = F.transform(folded, lambda line: F.struct((line["total"] / F.size(line["tokens"])).alias("mean"), F.array_min(F.transform(line["tokens"], lambda t: t["x1"])).alias("left"), F.array_sort(F.transform(line["tokens"], lambda t: F.struct(t["x1"], t["y1"], t["source_index"]))).alias("tokens")))
    numbered = F.transform(F.array_sort(keyed), lambda line, i: F.transform(line["tokens"], lambda t: F.struct(t["source_index"].alias("source_index"), i.alias("line_number"))))
    placed = grouped.select("image_id", F.posexplode(F.flatten(numbered)).alias("reconstructed_order", "t")).select("image_id", "reconstructed_order", F.col("t.source_index").alias("source_index"), F.col("t.line_number").alias("line_number"))
    return tokens.withColumn("normalized_text", collapse_space(F.col("text"))).join(placed, ["image_id", "source_index"])


def reconstructed_text(ordered: DataFrame) -> DataFrame:
    """One row for each image: its non-empty normalised tokens in reading order, and how many there are."""
    kept = F.array_sort(F.collect_list(F.when(F.col("normalized_text") != "", F.struct("reconstructed_order", "normalized_text"))))
    grouped = ordered.groupBy("image_id").agg(kept.alias("ts"), F.count(F.lit(1)).alias("n_tokens"))
    return grouped.select("image_id", "n_tokens", F.array_join(F.col("ts.normalized_text"), " ").alias("extracted_text"))
