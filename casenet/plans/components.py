"""Connected groups of an edge list by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casenet.plans.shared import SharedTables


def connected_components(edges: DataFrame, source: str = "a", target: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its least node.

    Each round takes the least label among the neighbours and then the label of
    that label, so a path of length n settles in about log n rounds. Rows are
    cut after each round by a table in the shared folder; only one count comes
    to the driver. Edges with a null end are ignored; an empty list gives none.
    """
    tables = SharedTables(edges.sparkSession)
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    both = tables.write(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("component", "low").alias("next"), "component")
        lower = tables.write(lower, "lower")
        jumped = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        labels = tables.write(jumped.select("node", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved")), "labels")
        tables.drop("lower")
        tables.drop("labels", all_but_last=True)
        if labels.where("moved").isEmpty():
            break
        labels = labels.drop("moved")
    else:
        raise RuntimeError(f"labels still moved after {max_rounds} rounds")
    tables.drop("links")
    return labels.select("node", "component")
