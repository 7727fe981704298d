"""Typed mentions with exact spans, by the category of a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casenet.functions import text as T
from casenet.functions.taxonomy import ENTITY_TYPES
from casenet.operators.validate import bad_spans

VERSION = "1.0"
LOW_OCR = 0.60
MENTIONED = (0, 2, 3)  # categories whose tokens hold mentions
# Fixed value: where a person's text turns into a station's.
SPLIT = r"(?i),\s*([^,]+(?:P\.S\.?|PS|Police\s+Station).*)$"
_MENTION = "array<struct<entity_type:string,raw_value:string,normalized_value:string,start_char:int,extraction_confidence:double,extraction_method:string>>"


def _mention(entity_type: str, raw: Column, normal: Column, start: Column, confidence: float, method: str) -> Column:
    return F.struct(F.lit(entity_type).alias("entity_type"), raw.alias("raw_value"), normal.alias("normalized_value"), start.cast("int").alias("start_char"), F.lit(confidence).alias("extraction_confidence"), F.lit(method).alias("extraction_method"))


def with_mentions(tokens: DataFrame) -> DataFrame:
    """Add ``ms``, the mentions of each token: category 0 a station, 2 statutes, 3 a person or "person, station"; others none.

    Each costly expression is a column of its own step, so it runs once for a
    row, and only for rows of a category that needs it.
    """
    text, category = F.col("text"), F.col("category_id")
    rows = tokens.withColumns({"__raw": F.when(category.isin(0, 2, 3), T.core(text)), "__pair": F.when(category == 3, F.regexp_extract(text, SPLIT, 0)), "__tail": F.when(category == 3, F.regexp_extract(text, SPLIT, 1))})
    split = F.col("__pair") != ""
    rows = rows.withColumn("__head", F.when(split, F.substring(text, F.lit(1), F.length(text) - F.length("__pair"))))
    rows = rows.withColumns({"__person": F.when(split, T.core(F.col("__head"))).when(category == 3, F.col("__raw")), "__station": F.when(split, T.core(F.col("__tail"))).when(category == 0, F.col("__raw"))})
    rows = rows.withColumns({"__named": T.plausible_name(F.col("__person")), "__normal_station": F.when(F.col("__station") != "", T.police_station(F.col("__station"))), "__normal_statute": F.when((category == 2) & (F.col("__raw") != ""), T.statute(F.col("__raw")))})
    rows = rows.withColumn("__normal_person", F.when(F.col("__named"), T.person_name(F.col("__person"))))
    begin = lambda whole, part: F.instr(F.col(whole), F.col(part)) - 1
    station_at = F.when(split, F.length(text) - F.length("__tail") + begin("__tail", "__station")).otherwise(begin("text", "__raw"))
    person = lambda start, confidence, method: F.when(F.col("__named"), _mention("PERSON", F.col("__person"), F.col("__normal_person"), start, confidence, method))
    station = lambda confidence, method: F.when(F.col("__station") != "", _mention("POLICE_STATION", F.col("__station"), F.col("__normal_station"), station_at, confidence, method))
    found = (
        F.when(category == 0, F.array(station(0.95, "category_0_station")))
        .when(category == 2, F.array(F.when(F.col("__raw") != "", _mention("STATUTE", F.col("__raw"), F.col("__normal_statute"), begin("text", "__raw"), 0.95, "category_2_statute"))))
        .when(split, F.array(person(begin("__head", "__person"), 0.90, "category_3_person_split"), station(0.92, "category_3_station_split")))
        .when(category == 3, F.array(person(begin("text", "__raw"), 0.92, "category_3_person")))
        .otherwise(F.array().cast(_MENTION))
    )
    return rows.withColumn("ms", F.array_compact(found))


def texts(tokens: DataFrame) -> DataFrame:
    """The different texts (category_id, text) that may hold mentions, dealt over as many partitions as there are tasks at once: parsing costs far more than their bytes."""
    rows = tokens.where(F.col("category_id").isin(*MENTIONED)).select("category_id", "text").distinct()
    return rows.repartition(tokens.sparkSession.sparkContext.defaultParallelism, "text")


def text_mentions(different: DataFrame) -> DataFrame:
    """category_id, text, ``ms``: the mentions of each of the ``different`` texts, so that a text which comes often is parsed once.

    Give it the written ``texts`` and write its result: in one plan Spark would
    push what filters the mentions below the step that makes texts different.
    """
    return with_mentions(different).select("category_id", "text", "ms")


def extract_mentions(tokens: DataFrame, low_ocr: float = LOW_OCR, parsed: DataFrame | None = None) -> DataFrame:
    """One row for each mention, with span, confidences and the token's place; see ``accepted`` and ``rejected``.

    ``parsed``: the ``text_mentions`` of these tokens, best as a written table,
    whose size tells Spark how to join it; without it each token is parsed.
    """
    keep = [c for c in ("case_id", "fir_id", "evidence_id", "image_id", "source_index", "category_id", "x1", "y1", "x2", "y2", "text") if c in tokens.columns]
    with_ms = with_mentions(tokens) if parsed is None else tokens.where(F.col("category_id").isin(*MENTIONED)).join(parsed, ["category_id", "text"])
    rows = with_ms.select(*keep, F.col("score").alias("ocr_confidence"), F.posexplode("ms").alias("span_index", "m")).select(*keep, "ocr_confidence", "span_index", "m.*")
    rows = rows.withColumn("end_char", (F.col("start_char") + F.length("raw_value")).cast("int"))
    return rows.withColumns({"final_confidence": T.fused_confidence(F.col("ocr_confidence"), F.col("extraction_confidence")), "low_ocr_confidence": F.col("ocr_confidence") < low_ocr, "extractor_version": F.lit(VERSION)})


def accepted(mentions: DataFrame) -> DataFrame:
    return mentions.where(~bad_spans(mentions))


def rejected(mentions: DataFrame) -> DataFrame:
    """Mentions whose span misses its text, with the reason."""
    return mentions.where(bad_spans(mentions)).withColumn("reason", F.lit("invalid_span"))


def rejected_documents(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested images without a usable document: image_id and the reason.

    ``documents``: image_id, fir_id, evidence_id, metadata_text (JSON text). JSON
    that parses but holds no array of records is ``metadata_without_records``; an
    empty array is a document without tokens and no rejection.
    """
    usable = documents.select("image_id", "fir_id", "evidence_id", "metadata_text", F.try_parse_json("metadata_text").isNull().alias("__broken"), F.from_json("metadata_text", STORED)["ocr_records"].isNull().alias("__bare"))
    rows = requested.select("image_id").distinct().join(usable, "image_id", "left")
    reason = F.when(F.col("fir_id").isNull(), "fir_missing").when(F.col("evidence_id").isNull(), "evidence_missing").when(F.col("__broken"), "metadata_unreadable").when(F.col("__bare"), "metadata_without_records")
    return rows.select("image_id", reason.alias("reason")).where("reason is not null")


STORED = "dataset_image_id bigint, image_name string, ocr_records array<struct<source_index: int, bbox: array<double>, score: double, category_id: int, original_text: string>>"


def _stored_documents(requested: DataFrame, firs: DataFrame, evidence: DataFrame) -> DataFrame:
    return firs.select("image_id", "fir_id", "case_id").join(evidence.select("fir_id", "case_id", "evidence_id", "metadata_text"), ["fir_id", "case_id"], "left").join(requested.select("image_id").distinct(), "image_id", "left_semi")


def extraction_job(requested: DataFrame, firs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of the ``requested`` images from their stored evidence, and the rejections (image_id, reason) of images and spans.

    ``firs``: fir_id, case_id, image_id; ``evidence``: evidence_id, fir_id,
    case_id, metadata_text, the nested JSON that holds the tokens. Every
    requested image has mentions, a rejection, or records without a mention.
    """
    stored = _stored_documents(requested, firs, evidence)
    whole = stored.withColumn("m", F.from_json("metadata_text", STORED)).where("m.ocr_records is not null")
    tokens = whole.select("case_id", "fir_id", "evidence_id", "image_id", F.col("m.image_name").alias("image_name"), F.explode("m.ocr_records").alias("t"))
    corner = lambda k, name: F.try_element_at("t.bbox", F.lit(k)).alias(name)
    tokens = tokens.select("case_id", "fir_id", "evidence_id", "image_id", "image_name", "t.source_index", corner(1, "x1"), corner(2, "y1"), corner(3, "x2"), corner(4, "y2"), "t.score", "t.category_id", F.col("t.original_text").alias("text"))
    mentions = extract_mentions(tokens)
    return accepted(mentions), rejected_documents(requested, stored).unionByName(rejected(mentions).select("image_id", "reason"))


def extraction_report(requested: DataFrame, firs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row that accounts for every requested image: images rejected, processed, and processed without a record; their records and mentions."""
    mentions, rejections = extraction_job(requested, firs, evidence)
    sizes = _stored_documents(requested, firs, evidence).select("image_id", F.size(F.from_json("metadata_text", STORED)["ocr_records"]).alias("n")).where("n >= 0")
    asked = requested.agg(F.count_distinct("image_id").alias("n_requested"))
    whole = sizes.agg(F.count_distinct("image_id").alias("n_processed"), F.count_if(F.col("n") == 0).alias("n_without_records"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_records"))
    lost = rejections.agg(F.count_distinct(F.when(F.col("reason") != "invalid_span", F.col("image_id"))).alias("n_rejected_images"), F.count_if(F.col("reason") == "invalid_span").alias("n_rejected_spans"))
    found = mentions.agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if("low_ocr_confidence").alias("n_low_ocr"), F.count_if(~F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False))).alias("n_unsupported"))
    return asked.join(whole, how="cross").join(lost, how="cross").join(found, how="cross")


def confident(mentions: DataFrame, least: float = 0.60) -> DataFrame:
    return mentions.where(F.col("final_confidence") >= least)


def image_summary(mentions: DataFrame) -> DataFrame:
    """Mentions of each image: all, low-OCR ones, and by type."""
    kinds = ("PERSON", "POLICE_STATION", "STATUTE")
    return mentions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if("low_ocr_confidence").alias("n_low_ocr"), *(F.count_if(F.col("entity_type") == k).alias(f"n_{k.lower()}") for k in kinds))


def section_identifiers(mentions: DataFrame) -> DataFrame:
    """One row for each section of a statute mention."""
    rows = mentions.where("entity_type = 'STATUTE'").select("case_id", "fir_id", "image_id", "source_index", F.posexplode(T.section_identifiers(F.col("raw_value"))).alias("position", "i"))
    return rows.select("case_id", "fir_id", "image_id", "source_index", "position", "i.*")


def extraction_metrics(mentions: DataFrame) -> DataFrame:
    """Counts by type and category: mentions, low-OCR ones, and repeats (rows beyond the first of an image and raw value)."""
    per_value = mentions.groupBy("entity_type", "category_id", "image_id", "raw_value").agg(F.count(F.lit(1)).alias("n"), F.count_if("low_ocr_confidence").alias("low"))
    return per_value.groupBy("entity_type", "category_id").agg(F.sum("n").alias("n_mentions"), F.sum("low").alias("n_low_ocr"), F.sum(F.col("n") - 1).alias("n_repeated"))
