"""Case roll-ups, reports, pages and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def case_kpis(cases: DataFrame, firs: DataFrame, evidence: DataFrame, entities: DataFrame, edges: DataFrame, analyses: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts of each case: one partial aggregation for each table, joined once on the case."""

    def count(df: DataFrame, name: str, *more: Column) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name), *more)

    typed = lambda t, name: F.count_if(F.col("entity_type") == t).alias(name)
    parts = [
        count(firs, "n_firs"), count(evidence, "n_evidence"), count(entities, "n_entities", typed("PERSON", "n_persons"), typed("POLICE_STATION", "n_stations"), typed("STATUTE", "n_statutes")),
        count(edges, "n_edges"), count(analyses, "n_analyses"), count(alerts, "n_alerts"),
    ]
    joined = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, cases.select("case_id").distinct())
    return joined.select("case_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "case_id"))


def numbered_alerts(alerts: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` alerts of each case by falling ``order``, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(order)))
    return alerts.withColumn("alert_number", rank).where(F.col("alert_number") <= n)


def case_reports(kpis: DataFrame, alerts: DataFrame, order: str) -> DataFrame:
    """One Markdown report for each case: its figures and its ten newest alerts."""
    top = numbered_alerts(alerts, order)
    line = F.concat(F.lit("- **Alert #"), F.col("alert_number").cast("string"), F.lit(" ["), F.col("severity"), F.lit("]** "), F.col("title"))
    listed = top.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("alert_number", line.alias("line")))).alias("ls")).select("case_id", F.array_join("ls.line", "\n").alias("alert_text"))
    rows = kpis.join(listed, "case_id", "left")
    item = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    title = F.concat(F.lit("Case network report "), F.col("case_id").cast("string"))
    content = F.concat_ws("\n", F.concat(F.lit("# "), title), item("Documents", "n_firs"), item("Evidence", "n_evidence"), item("Entities", "n_entities"), item("Persons", "n_persons"), item("Stations", "n_stations"), item("Statutes", "n_statutes"), item("Edges", "n_edges"), item("Analyses", "n_analyses"), item("Alerts", "n_alerts"), F.coalesce("alert_text", F.lit("No alerts for this case.")))
    return rows.select("case_id", F.lit("CRIMINAL_NETWORK_SUMMARY").alias("report_type"), title.alias("title"), content.alias("content"))


def numbered_mentions(mentions: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` mentions in the order of image, token and span, numbered ``cand_001`` and on; for small reports, as a number needs one order of all."""
    first = mentions.orderBy("image_id", "source_index", "span_index").limit(n)
    rank = F.row_number().over(Window.orderBy("image_id", "source_index", "span_index"))
    return first.withColumn("mention_id", F.format_string("cand_%03d", rank))


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100, most: int = 100, **wanted) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the filtered table in a total order, each with the total count."""
    from casenet.operators.validate import equals

    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset is 0 or more and limit from 1 to {most}")
    rows = equals(df, **wanted)
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), how="cross")


def traceability(provenance: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every mention down to its document, and whether entity and evidence belong to one case."""
    rows = provenance.join(evidence.select("evidence_id", "fir_id", F.col("case_id").alias("evidence_case")), "evidence_id").join(entities.select("entity_key", F.col("case_id").alias("entity_case")), "entity_key")
    return rows.withColumn("same_case", F.col("entity_case") == F.col("evidence_case"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()))
