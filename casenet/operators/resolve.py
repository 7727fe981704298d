"""Conservative resolution of mentions into canonical entities.

Institutions and statutes are one entity across the documents of a case;
persons who share a name are one entity within a document only, unless the
caller asks for merging. The first mention of a key (document, token, span
order) names it. Firsts come from partial aggregates by name and document, joined
back by both, so the mentions of a frequent name meet in no task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casenet.functions.taxonomy import BUSINESS_IDENTIFIERS, ENTITY_TYPES
from casenet.plans.shared import Manifest, SharedTables, delete, exists, new_path
from casenet.sources.sinks import append_new, one_of_each

ORDER = ("batch", "image_id", "source_index", "span_index")


def entity_key(case_id: Column, entity_type: Column, norm_key: Column, fir_id: Column | None = None) -> Column:
    parts = [case_id.cast("string"), entity_type, norm_key] + ([fir_id.cast("string")] if fir_id is not None else [])
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def mention_key(evidence_id: Column, source_index: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (evidence_id, source_index, start, end))), 256)


def _decision_reason(decision: Column) -> Column:
    name = F.trim("normalized_value")
    return (
        F.when(decision == "KEPT_SEPARATE_AMBIGUOUS", F.when(F.col("supported"), "Normalized value is empty or too short").otherwise(F.concat(F.lit("Unsupported entity type "), F.col("entity_type"))))
        .when(decision == "CREATED_NEW", F.concat(F.lit("First occurrence of "), F.col("entity_type"), F.lit(" '"), name, F.lit("' in case "), F.col("case_id").cast("string")))
        .when(decision == "KEPT_SEPARATE_CROSS_FIR", F.concat(F.lit("Same person name '"), name, F.lit("' in another document kept separate")))
        .when(decision == "MATCHED_EXISTING_SAME_FIR", F.concat(F.lit("Exact match of '"), name, F.lit("' within document "), F.col("fir_id").cast("string")))
        .otherwise(F.concat(F.lit("Exact match of '"), name, F.lit("' across documents of the case")))
    )


def by_document(entity_type: Column) -> Column:
    """Whether entities of a type are of one document each, unless persons are merged."""
    return entity_type == "PERSON"


def _keyed(mentions: DataFrame, merge_persons: bool, hashed: bool = False) -> DataFrame:
    """Mentions with ``group_key`` (what may be one entity; null where a mention is ambiguous) and ``by_document``.

    A group's key is its plain text, shorter than a digest and alike in
    neighbouring rows; ``hashed`` gives the digest, which stored states hold.
    """
    rows = mentions if "batch" in mentions.columns else mentions.withColumn("batch", F.lit(1))
    rows = rows.withColumns({"supported": F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False)), "by_document": by_document(F.col("entity_type")) if not merge_persons else F.lit(False)})
    clear = F.col("supported") & (F.length(F.coalesce(F.trim("normalized_value"), F.lit(""))) >= 2)
    norm = F.lower(F.trim("normalized_value"))
    group = entity_key(F.col("case_id"), F.col("entity_type"), norm) if hashed else F.concat_ws("|", F.coalesce(F.col("case_id").cast("string"), F.lit("")), "entity_type", norm)
    return rows.withColumn("group_key", F.when(clear, group))


def _in_documents(rows: DataFrame) -> DataFrame:
    """The first mention of each group in each document: group_key, fir_id, by_document, ``own`` (place and raw value)."""
    known = rows.where("group_key is not null")
    return known.groupBy("group_key", "fir_id").agg(F.min(F.struct(F.struct(*ORDER).alias("place"), "raw_value")).alias("own"), F.first("by_document").alias("by_document"))


def _firsts(in_documents: DataFrame) -> DataFrame:
    return in_documents.groupBy("group_key").agg(F.min(F.struct(F.col("own.place").alias("place"), "fir_id", F.col("own.raw_value").alias("raw_value"))).alias("first"))


def _decided(rows: DataFrame, in_documents: DataFrame) -> DataFrame:
    named = in_documents.select("group_key", "fir_id", "own").join(_firsts(in_documents), "group_key").toDF("__group", "__fir", "own", "first")
    joined = rows.join(named, (F.col("group_key") == F.col("__group")) & F.col("fir_id").eqNullSafe(F.col("__fir")), "left").drop("__group", "__fir")
    decision = (
        F.when(F.col("group_key").isNull(), "KEPT_SEPARATE_AMBIGUOUS")
        .when(F.struct(*ORDER) == F.col("first.place"), "CREATED_NEW")
        .when(F.col("fir_id").eqNullSafe(F.col("first.fir_id")), "MATCHED_EXISTING_SAME_FIR")
        .when(F.col("by_document"), "KEPT_SEPARATE_CROSS_FIR")
        .otherwise("MATCHED_EXISTING_CROSS_FIR")
    )
    joined = joined.withColumns({"decision": decision, "entity_name": F.trim(F.when(F.col("by_document"), F.col("own.raw_value")).otherwise(F.col("first.raw_value")))})
    place = (F.col("case_id"), F.col("entity_type"), F.lower(F.trim("normalized_value")))
    own = F.when(F.col("by_document"), entity_key(*place, F.col("fir_id"))).otherwise(entity_key(*place))  # made here, so that no digest goes through a shuffle
    return joined.withColumns({"reason": _decision_reason(F.col("decision")), "entity_key": F.when(F.col("group_key").isNotNull(), own)}).drop("first", "own", "supported", "by_document", "group_key")


def resolve(mentions: DataFrame, merge_persons: bool = False) -> DataFrame:
    """Add ``decision``, ``reason``, ``entity_key`` and ``entity_name`` to each mention; ambiguous ones get no entity.

    ``mentions`` may hold a ``batch`` column: lower batches were stored earlier
    and come first in every order. The documents of one name meet its first
    mention in a plain join, whose larger side AQE can split; its mentions don't.
    """
    rows = _keyed(mentions, merge_persons)
    return _decided(rows, _in_documents(rows))


STATE_COLUMNS = "group_key string, fir_id bigint, image_id bigint, source_index int, span_index int, raw_value string, by_document boolean"


class EntityState:
    """Stored entities, for resolution without their mentions: a table bucketed and sorted by group key, one partition for each batch.

    A row is the first mention of an entity: its group, document, place and raw
    value (persons are entities of a document, others of a case). Each bucket is
    read where it lies, and a batch is dealt to the buckets. The manifest names
    the batches that count; a partition that it does not name is what a failure
    left, is never read and is written anew. ``path`` opens a state again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16, merge_persons: bool = False):
        self.spark, self.path = spark, path or new_path(spark, "entity-state")
        self.manifest = Manifest(spark, f"{self.path}/_manifest")
        begun = self.manifest.entries()
        if not begun:
            self.manifest.commit({"buckets": buckets, "merge_persons": merge_persons})
            begun = self.manifest.entries()
        self.buckets, self.merge_persons = begun[0]["buckets"], begun[0]["merge_persons"]
        self.table = f"entity_state_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} ({STATE_COLUMNS}, batch int) USING parquet PARTITIONED BY (batch) CLUSTERED BY (group_key) SORTED BY (group_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entities'")
        if exists(spark, f"{self.path}/entities"):
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def batches(self) -> dict[str, int]:
        """Number of each stored batch by its name."""
        return {entry["batch"]: k for k, entry in enumerate(self.manifest.entries()) if "batch" in entry}

    def read(self) -> DataFrame:
        """The stored entities of all batches that count."""
        return self.spark.table(self.table).where(F.col("batch") <= max(self.batches().values(), default=0))

    def known(self, groups: DataFrame) -> DataFrame:
        """Stored entities of ``groups`` (group_key, each once)."""
        return self.read().join(groups.repartition(self.buckets, "group_key"), "group_key", "left_semi")

    def add(self, entities: DataFrame, batch: str) -> None:
        """Store the entities of a batch that is new, and then name it."""
        number = len(self.manifest.entries())
        delete(self.spark, f"{self.path}/entities/batch={number}")
        rows = entities.withColumn("batch", F.lit(number)).repartition(self.buckets, "group_key")
        rows.write.format("parquet").mode("append").partitionBy("batch").bucketBy(self.buckets, "group_key").sortBy("group_key").option("path", f"{self.path}/entities").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        self.manifest.commit({"batch": batch})

    def close(self) -> None:
        """Forget the catalog name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def delete(self) -> None:
        self.close()
        delete(self.spark, self.path)


def resolve_incremental(state: EntityState, incoming: DataFrame, batch: str) -> DataFrame:
    """Resolutions of ``incoming`` against the entities stored before, which are read instead of their mentions; stores what is new.

    A batch that comes again under its name is decided as at first and adds
    nothing. Stored persons keep their documents.
    """
    tables = SharedTables(state.spark)
    number = state.batches().get(batch)
    rows = _keyed(incoming.withColumn("batch", F.lit(len(state.manifest.entries()) if number is None else number)), state.merge_persons, hashed=True)
    own = tables.write(_in_documents(rows), "in-documents")
    stored = state.known(own.select("group_key").distinct())
    known = tables.write(stored.select("group_key", "fir_id", F.struct(F.struct(*ORDER).alias("place"), "raw_value").alias("own"), "by_document"), "known")
    whole = own.unionByName(known).groupBy("group_key", "fir_id").agg(F.min("own").alias("own"), F.first("by_document").alias("by_document"))
    resolved = tables.write(_decided(rows, whole), "resolved")
    if number is None:
        persons = own.where("by_document").join(known.select("group_key", F.col("fir_id").alias("__fir"), F.lit(True).alias("__old")), (own["group_key"] == known["group_key"]) & F.col("fir_id").eqNullSafe(F.col("__fir")), "left_anti")
        others = _firsts(own.where(~F.col("by_document")).join(known.select("group_key").distinct(), "group_key", "left_anti"))
        place = [F.col(f"place.{c}").alias(c) for c in ORDER if c != "batch"]
        fresh = persons.select("group_key", "fir_id", "own.*", "by_document").unionByName(others.select("group_key", "first.*", F.lit(False).alias("by_document"))).select("group_key", "fir_id", *place, "raw_value", "by_document")
        state.add(tables.write(fresh, "fresh"), batch)
    tables.drop("in-documents", "known", "fresh")
    return resolved


def keyed(mentions: DataFrame, merge_persons: bool = False) -> DataFrame:
    """Mentions with ``entity_key`` alone, which depends on the mention itself: null where ``resolve`` gives none, else what it gives, before its digest is taken.

    What needs neither decisions nor names reads this, without the steps over
    groups; ``digest`` makes the keys of ``resolve`` from these.
    """
    rows = _keyed(mentions, merge_persons)
    own = F.concat_ws("|", "group_key", F.coalesce(F.col("fir_id").cast("string"), F.lit("")))
    key = F.when(F.col("by_document"), own).otherwise(F.col("group_key"))
    return rows.withColumn("entity_key", F.when(F.col("group_key").isNotNull(), key)).drop("group_key", "by_document", "supported", *(["batch"] if "batch" not in mentions.columns else []))


def digest(key: Column) -> Column:
    """The 32 bytes of the entity key, which order as its hexadecimal text does."""
    return F.unhex(F.sha2(key, 256))


def entities_of(mentions: DataFrame, merge_persons: bool = False) -> DataFrame:
    """``entities(resolve(mentions))`` from the mentions themselves, ``entity_key`` in bytes.

    No mention meets its group. Entities of one document are groups of mentions;
    those of several come from partial aggregates by group, and only their
    different documents, counted apart, are as many rows as mentions.
    """
    rows = _keyed(mentions, merge_persons).where("group_key is not null").withColumn("normalized_name", F.lower(F.trim("normalized_value")))
    group = ["group_key", "entity_type", "normalized_name"]
    named = [F.min("case_id").alias("case_id"), F.min(F.struct(F.struct(*ORDER).alias("place"), "raw_value")).alias("first"), F.max("final_confidence").alias("confidence"), F.count(F.lit(1)).alias("n_mentions")]
    own = rows.where("by_document").groupBy(*group, "fir_id").agg(*named).withColumns({"n_firs": F.when(F.col("fir_id").isNull(), 0).otherwise(1).cast("bigint"), "group_key": F.concat_ws("|", "group_key", F.coalesce(F.col("fir_id").cast("string"), F.lit("")))})
    wide = rows.where(~F.col("by_document"))
    documents = wide.select("group_key", "fir_id").distinct().groupBy("group_key").agg(F.count("fir_id").alias("n_firs"))
    shared = wide.groupBy(*group).agg(*named).join(documents, "group_key")
    both = own.drop("fir_id").unionByName(shared)
    return both.select(digest(F.col("group_key")).alias("entity_key"), "case_id", "entity_type", F.trim("first.raw_value").alias("name"), "normalized_name", "confidence", "n_mentions", "n_firs")


def entity_names(mentions: DataFrame) -> DataFrame:
    """The different entity_type and normalized_name of the entities, from the mentions alone."""
    return _keyed(mentions, False).where("group_key is not null").select("entity_type", F.lower(F.trim("normalized_value")).alias("normalized_name")).distinct()


def entities(resolutions: DataFrame) -> DataFrame:
    """One row for each canonical entity."""
    rows = resolutions.where("entity_key is not null")
    return rows.groupBy("entity_key").agg(
        F.min("case_id").alias("case_id"), F.min("entity_type").alias("entity_type"), F.min("entity_name").alias("name"), F.min(F.lower(F.trim("normalized_value"))).alias("normalized_name"),
        F.max("final_confidence").alias("confidence"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("fir_id").alias("n_firs"),
    )


PLACE = ("evidence_id", "source_index", "start_char", "end_char")  # what tells mentions apart


def provenance(resolutions: DataFrame) -> DataFrame:
    """One row for each mention of an entity, with key, span, confidences and box; of repeated coordinates the least row."""
    columns = ["entity_key", *PLACE[:2], "category_id", *PLACE[2:], "raw_value", "ocr_confidence", "extraction_confidence", "final_confidence", "low_ocr_confidence", "extraction_method", "extractor_version", "x1", "y1", "x2", "y2"]
    rows = one_of_each(resolutions.where("entity_key is not null").select(*columns), *PLACE)
    return rows.select(mention_key(*map(F.col, PLACE)).alias("mention_key"), *columns)


def provenance_links(mentions: DataFrame, merge_persons: bool = False) -> DataFrame:
    """The narrow part of ``provenance``, of the same rows: coordinates and ``entity_key`` in bytes, dealt by evidence.

    Needs no resolution. ``mention_key`` of the coordinates is best made at the
    end, so that no digest goes through a shuffle.
    """
    rows = keyed(mentions, merge_persons).where("entity_key is not null")
    return rows.select(*PLACE, digest(F.col("entity_key")).alias("entity_key")).repartition("evidence_id").groupBy(*PLACE).agg(F.min("entity_key").alias("entity_key"))


def provenance_values(mentions: DataFrame, merge_persons: bool = False) -> DataFrame:
    """The columns mention_key, entity_key, PLACE and raw_value of ``provenance``, of the same rows, without a resolution.

    Keys go through the one shuffle as the text that they are digests of.
    """
    rows = keyed(mentions, merge_persons).where("entity_key is not null").select(*PLACE, F.col("entity_key").alias("__text"), "category_id", "raw_value").repartition("evidence_id")
    once = one_of_each(rows.withColumn("entity_key", digest(F.col("__text"))).select(*PLACE, "entity_key", "category_id", "raw_value"), *PLACE)
    return once.select(mention_key(*map(F.col, PLACE)).alias("mention_key"), F.lower(F.hex("entity_key")).alias("entity_key"), *PLACE, "raw_value")


def scope_entities(image_ids: DataFrame, firs: DataFrame, evidence: DataFrame, provenance: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that a mention links to one of ``image_ids``: image, document, evidence, mention, each by a semi-join."""
    wanted = firs.join(image_ids.select("image_id").distinct(), "image_id", "left_semi")
    proof = evidence.join(wanted.select("fir_id").distinct(), "fir_id", "left_semi")
    mentioned = provenance.join(proof.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return entities.join(mentioned.select("entity_key").distinct(), "entity_key", "left_semi")


def resolution_job(mentions: DataFrame, evidence: DataFrame, path: str, requested: DataFrame, allowed: DataFrame | None = None, merge_persons: bool = False) -> tuple[DataFrame, DataFrame]:
    """Resolve the mentions of the ``requested`` images and append what ``path`` lacks; returns resolutions and one row of metrics.

    Stops before any work if an image is outside ``allowed`` or a mention is not
    owned by its evidence. A second run appends nothing.
    """
    from casenet.operators.validate import ownership, require_scope

    if allowed is not None:
        require_scope(requested, allowed)
    rows = mentions.join(requested.select("image_id").distinct(), "image_id", "left_semi")
    if not ownership(rows, evidence).where("ownership_reason is not null").isEmpty():
        raise ValueError("mentions that their evidence does not own")
    resolved = resolve(rows, merge_persons)
    fresh = append_new(provenance(resolved), path, "evidence_id", "source_index", "start_char", "end_char")
    metrics = resolution_metrics(resolved).join(F.broadcast(fresh.agg(F.count(F.lit(1)).alias("n_appended"))), how="cross")
    return resolved, metrics


def resolution_metrics(resolutions: DataFrame) -> DataFrame:
    """One row: decisions and what the cross-document policy prevented or matched."""
    decided = lambda d, t=None: F.count_if((F.col("decision") == d) & ((F.col("entity_type") == t) if t else F.lit(True)))
    return resolutions.agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("entity_key").alias("n_entities"), decided("CREATED_NEW").alias("n_created"), decided("MATCHED_EXISTING_SAME_FIR").alias("n_same_fir"),
        decided("KEPT_SEPARATE_CROSS_FIR").alias("n_person_matches_prevented"), decided("KEPT_SEPARATE_AMBIGUOUS").alias("n_ambiguous"),
        decided("MATCHED_EXISTING_CROSS_FIR", "POLICE_STATION").alias("n_cross_fir_stations"), decided("MATCHED_EXISTING_CROSS_FIR", "STATUTE").alias("n_cross_fir_statutes"),
    )


def run_report(resolutions: DataFrame, stored_entities: DataFrame) -> DataFrame:
    """One row: entities created and reused by a batch, and whether it was a mere rerun."""
    touched = resolutions.where("entity_key is not null").select("entity_key").distinct()
    flagged = touched.join(stored_entities.select("entity_key", F.lit(1).alias("old")).distinct(), "entity_key", "left")
    counts = flagged.agg(F.count_if(F.col("old").isNull()).alias("n_created"), F.count("old").alias("n_reused"), F.count(F.lit(1)).alias("n_total"))
    return counts.withColumn("is_rerun", (F.col("n_created") == 0) & (F.col("n_reused") > 0))


def business_identifiers(resolutions: DataFrame) -> DataFrame:
    """Identifiers of the allowed types from an ``identifiers`` array column, one row for each entity, type and value, with the least evidence that holds it."""
    rows = resolutions.where("entity_key is not null").select("entity_key", "evidence_id", F.explode("identifiers").alias("i")).select("entity_key", "i.*", F.col("evidence_id").alias("source_evidence_id"))
    return one_of_each(rows.where(F.col("identifier_type").isin(*BUSINESS_IDENTIFIERS)), "entity_key", "identifier_type", "identifier_value", first="source_evidence_id")


# Patterns of identifiers in free text (ours); digits keep their separators in the raw value.
IDENTIFIER_PATTERNS = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "PHONE": r"\+[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{4}"}


def identifiers_in_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifiers found in free text: id, identifier_type, identifier_value, normalized_value, n_found."""
    text = F.coalesce(text_column, F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("t"), v.alias("v")))

    found = F.flatten(F.array(*(of(kind, pattern) for kind, pattern in IDENTIFIER_PATTERNS.items())))
    rows = docs.select(id_column, F.explode(found).alias("i"))
    normal = F.when(F.col("i.t") == "EMAIL", F.lower("i.v")).otherwise(F.regexp_replace("i.v", "[^0-9+]", ""))
    return rows.groupBy(id_column, F.col("i.t").alias("identifier_type"), F.col("i.v").alias("identifier_value"), normal.alias("normalized_value")).agg(F.count(F.lit(1)).alias("n_found"))
