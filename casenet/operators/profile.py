"""Profiles and import planning of a batch of OCR documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts and score bounds; nulls as bounds of an empty batch."""
    own = tokens.agg(F.count(F.lit(1)).alias("ocr_records"), F.count_distinct("image_id").alias("annotated_images"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    disk = files.agg(F.count(F.lit(1)).alias("images_on_disk"))
    repeated = tokens.groupBy("image_id", "text").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("redundant_records"))
    return own.join(F.broadcast(disk), how="cross").join(F.broadcast(repeated), how="cross")


def category_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_records"))


def redundant_texts(tokens: DataFrame) -> DataFrame:
    """Texts that an image repeats: image_id, text, extra (records beyond the first)."""
    return tokens.groupBy("image_id", "text").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def import_plan(images: DataFrame, firs: DataFrame, evidence: DataFrame, dry_run: bool = True) -> DataFrame:
    """Status of each image of a batch against what is stored.

    ``images``: image_id, case_id, image_sha256, archive_sha256, dataset_name;
    ``firs``: fir_id, case_id, image_id; ``evidence``: fir_id, file_hash,
    metadata_text. Metadata that is not JSON counts as a row without a match.
    """
    field = lambda name: F.get_json_object("metadata_text", f"$.{name}")
    stored = firs.select("image_id", F.col("fir_id"), F.col("case_id").alias("fir_case"))
    proof = evidence.select(F.col("fir_id"), F.col("file_hash"), field("dataset_name").alias("m_dataset"), field("archive_sha256").alias("m_archive"), field("dataset_image_id").cast("string").alias("m_image"), F.lit(1).alias("has_evidence"))
    rows = images.join(stored, "image_id", "left").join(proof, "fir_id", "left")
    fits = (F.col("file_hash") == F.col("image_sha256")) & (F.col("m_dataset") == F.col("dataset_name")) & (F.col("m_archive") == F.col("archive_sha256")) & (F.col("m_image") == F.col("image_id").cast("string"))
    grouped = rows.groupBy("image_id", "case_id").agg(F.min("fir_id").alias("fir_id"), F.min("fir_case").alias("fir_case"), F.count("has_evidence").alias("n_evidence"), F.count_if(F.coalesce(fits, F.lit(False))).alias("n_matching"))
    status = (
        F.when(F.col("fir_id").isNull(), F.lit("PROPOSED" if dry_run else "IMPORTED"))
        .when(F.col("fir_case") != F.col("case_id"), "CONFLICT")
        .when(F.col("n_evidence") == 0, "RESUMED")
        .when((F.col("n_evidence") == 1) & (F.col("n_matching") == 1), "ALREADY_IMPORTED")
        .otherwise("CONFLICT")
    )
    return grouped.select("image_id", "case_id", "fir_id", "n_evidence", status.alias("status"))


def status_counts(plan: DataFrame) -> DataFrame:
    """Counters by status; PROPOSED rows are not counted as work done."""
    return plan.where("status <> 'PROPOSED'").groupBy("status").agg(F.count(F.lit(1)).alias("n_images"))
