"""Scans of OCR annotations, image folders and other processors' output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casenet.plans.shared import SharedTables

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")  # fixed value
EXTERNAL_SCHEMA = "fir_id string, source_image string, entities array<struct<id:string,type:string,value:string>>"


def read_annotation_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON array files of objects: ``source_index`` in their file and the record as VARIANT.

    Files are read in byte ranges, cut behind each ``}``. Whether such a cut ends
    a record follows from the quotes and braces before it: each range adds up its
    own, one row for each range goes through a running total, and pieces are put
    together again by the number of records that ended before them. A record
    that is not JSON, and a file that ends without ``]``, are errors.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    # Without escaped characters, what lies between quotes is text, and then what is not is structure.
    bare = F.regexp_replace("value", r"\\.", "")
    tables = SharedTables(spark)
    pieces = tables.write(pieces.withColumns({"bare": bare, "quotes": F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))}), "pieces")
    rows = _before(pieces, "quotes").withColumn("open", F.pmod("before", F.lit(2)) == 1)
    structure = F.array_join(F.filter(F.split("bare", '"'), lambda _, k: (k + F.col("open").cast("int")) % 2 == 0), "")
    inside = F.pmod(F.col("open").cast("int") + F.col("quotes"), F.lit(2)) == 1  # the brace behind the piece is text
    opened = F.length(structure) - F.length(F.replace(structure, F.lit("{"), F.lit("")))
    rows = tables.write(rows.select("value", "file", "start", "row", (opened - F.when(inside, 0).otherwise(1)).alias("step"), inside.alias("inside")), "stepped")
    ends = (F.col("before") + F.col("step") == 0) & ~F.col("inside")
    rows = tables.write(_before(rows, "step").select("value", "file", "start", "row", ends.cast("int").alias("ends")), "ended")
    whole = _before(rows, "ends").groupBy("file", F.col("before").alias("source_index")).agg(F.array_sort(F.collect_list(F.struct("start", "row", "value"))).alias("parts"), F.max("ends").alias("ends"))
    last = pieces.groupBy("file").agg(F.max_by("value", F.struct("start", "row")).rlike(r"^[\s\[\x{feff}]*\]\s*$").alias("sound"))
    whole = whole.join(last, "file").where(F.when(F.col("sound"), F.col("ends") == 1).otherwise(F.raise_error(F.lit("a file does not end behind a record")).cast("boolean")))
    text = F.regexp_replace(F.array_join("parts.value", "}"), r"^[\s,\[\x{feff}]+", "")
    return whole.select("source_index", F.parse_json(F.concat(text, F.lit("}"))).alias("record"))


def _before(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``column`` over what stands before in the file: a window within each range, and one number for all earlier ranges."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "start").agg(F.sum(column).alias("n")).select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("file", "start").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ranges, ["file", "start"]).withColumn("before", F.coalesce(F.sum(column).over(own), F.lit(0)) + F.col("base")).drop("base")


def read_annotation_lines(spark: SparkSession, path: str, index_field: str = "source_index") -> DataFrame:
    """Records of splittable JSON lines that carry their own index; a broken line gives a null record."""
    parsed = spark.read.text(path).select(F.try_parse_json("value").alias("record"))
    return parsed.select(F.try_variant_get("record", f"$.{index_field}", "bigint").alias("source_index"), "record")


def list_images(spark: SparkSession, root: str, with_hash: bool = False) -> DataFrame:
    """image_name, path, length (and sha256) of all image files below ``root``; contents are read only to hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES))
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("image_name")
    return files.select(name, "path", "length", *([F.sha2("content", 256).alias("sha256")] if with_hash else []))


def read_external(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTERNAL_SCHEMA).option("multiLine", True).json(path)


def external_entities(external: DataFrame) -> DataFrame:
    """The other processor's entities as mentions; types that are not taken over are dropped."""
    from casenet.functions.taxonomy import external_type

    image = F.when(F.col("fir_id").startswith("FIR_"), F.regexp_replace("fir_id", "FIR_", "").try_cast("bigint"))
    rows = external.select("fir_id", "source_image", image.alias("image_id"), F.explode("entities").alias("e"))
    rows = rows.select("fir_id", "source_image", "image_id", F.col("e.id").alias("temp_id"), external_type(F.col("e.type")).alias("entity_type"), F.col("e.value").alias("raw_value"), F.trim(F.coalesce("e.value", F.lit(""))).alias("normalized_value"), F.col("e.type").alias("original_type"))
    return rows.where("entity_type is not null")


def parse_ids(text: str | None) -> list[int] | None:
    """A comma-separated list of ids, None if there is none; anything but digits is an error."""
    if text is None or not text.strip():
        return None
    parts = [part.strip() for part in text.split(",") if part.strip()]
    if not all(part.isascii() and part.isdigit() for part in parts):
        raise ValueError(f"not a list of ids: {text!r}")
    return [int(part) for part in parts]


def semi_scan(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of ``table`` whose key is in ``keys``, never through a literal list."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")
