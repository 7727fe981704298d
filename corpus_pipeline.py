"""From raw documents to packed training batches, in five stages.

Each stage works on all that the one before kept: quality classifier, exact
dedup, MinHash near-dedup, suffix-array dedup, packing. All but the last return
the columns of ``documents``; ``run`` writes each stage as Parquet in the shared
folder and reads it again, so a lost executor never costs an earlier stage. What
a stage wrote for itself is deleted when its result is written, and the result
when the next one is.

Edge cases: a null text is an empty document; empty texts are equal, so one of
them passes the exact stage; a row is known by its id and text, so different
texts of one id or of none are different documents, and of rows equal in both
one stays; rows without an id are never near-duplicates and keep their passages;
of equal or near texts the smallest doc_id stays; texts of any length are taken
whole; extra columns are passed on as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casenet.llm import byte_bpe, exact_dedup, minhash_dedup, packing, quality_classifier, suffix_dedup
from casenet.plans.shared import delete, new_path, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 on five-word shingles."""
    return minhash_dedup.keep_one(docs, shingle_words=5, percent=80, bands=28, rows=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold."""
    return suffix_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and padding of each remaining document, in tokens of the byte-level encoding."""
    return packing.pack(byte_bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), length=F.col("n_tokens"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
