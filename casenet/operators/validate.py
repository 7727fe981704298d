"""Validation with quarantine: every rule adds its reason, bad rows are split off, none is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("bbox", "category_id", "image_id", "image_name", "score", "text")


def typed_record(records: DataFrame) -> DataFrame:
    """Typed columns of a VARIANT ``record`` and the ``violations`` that only its JSON types show."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get("record", path, "variant"))
    get = lambda path, t: F.try_variant_get("record", path, t)
    bbox = get("$.bbox", "array<variant>")
    number = lambda v: F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL)")
    rules = [
        (F.coalesce(F.array_sort(F.json_object_keys(F.to_json("record"))), F.array().cast("array<string>")) != F.array(*map(F.lit, FIELDS)), "fields"),
        (~F.coalesce(kind("$.image_id") == "BIGINT", F.lit(False)) | (F.coalesce(get("$.image_id", "bigint"), F.lit(-1)) < 0), "image_id"),
        (~F.coalesce(kind("$.image_name") == "STRING", F.lit(False)), "image_name"),
        (~F.coalesce((F.size(bbox) == 4) & F.forall(bbox, number), F.lit(False)), "bbox"),
        (~F.coalesce(kind("$.score").rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)), "score"),
        (~F.coalesce(kind("$.category_id") == "BIGINT", F.lit(False)), "category_id"),
        (~F.coalesce(kind("$.text") == "STRING", F.lit(False)), "text"),
    ]
    box = get("$.bbox", "array<double>")
    corner = lambda k: F.try_element_at(box, F.lit(k))
    return records.select(
        "source_index", get("$.image_id", "bigint").alias("image_id"), get("$.image_name", "string").alias("image_name"),
        corner(1).alias("x1"), corner(2).alias("y1"), corner(3).alias("x2"), corner(4).alias("y2"),
        get("$.score", "double").alias("score"), get("$.category_id", "bigint").alias("category_id"), get("$.text", "string").alias("text"), reasons(rules).alias("type_violations"),
    )


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules that a row breaks, in rule order."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules)))


def check_tokens(tokens: DataFrame) -> DataFrame:
    """Add ``violations`` and ``warnings`` to token rows; the first violation is the first rule that fails."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    corners = reduce(Column.__and__, (finite(c) for c in ("x1", "y1", "x2", "y2")))
    rules = [
        (F.col("image_id").isNull() | (F.col("image_id") < 0), "image_id"),
        (F.col("image_name").isNull() | (F.trim("image_name") == "") | F.col("image_name").contains("/"), "image_name"),
        (~corners, "bbox"),
        (corners & ((F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1"))), "reversed_bbox"),
        (~F.coalesce(finite("score") & F.col("score").between(0, 1), F.lit(False)), "score"),
        (F.col("category_id").isNull(), "category_id"),
        (F.col("text").isNull(), "text"),
    ]
    found = reasons(rules)
    if "type_violations" in tokens.columns:
        found = F.array_distinct(F.concat("type_violations", found))
    blank = F.coalesce(F.regexp_replace("text", r"(?U)\s+", "") == "", F.lit(False))
    return tokens.withColumns({"violations": found, "warnings": reasons([(blank, "empty_text")])}).drop("type_violations")


def missing_images(checked: DataFrame, files: DataFrame) -> DataFrame:
    """``missing_image`` as a further violation where no file has the row's image name."""
    known = files.select("image_name", F.lit(True).alias("__on_disk")).distinct()
    joined = checked.join(known, "image_name", "left")
    return joined.withColumn("violations", F.when(F.col("__on_disk").isNull(), F.array_append("violations", F.lit("missing_image"))).otherwise(F.col("violations"))).drop("__on_disk")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows; the second keep all their reasons."""
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def identity_conflicts(tokens: DataFrame, left: str = "image_id", right: str = "image_name") -> DataFrame:
    """Values on either side of what should be a one-to-one map that have several partners: side, value, n_partners.

    Least and greatest partner find the conflicts in one partial aggregation.
    """

    def side(a: str, b: str) -> DataFrame:
        several = tokens.where(f"{a} is not null").groupBy(a).agg(F.count_distinct(b).alias("n_partners")).where("n_partners > 1")
        return several.select(F.lit(a).alias("side"), F.col(a).cast("string").alias("value"), "n_partners")

    return side(left, right).unionByName(side(right, left))


def duplicate_keys(df: DataFrame, *key: str, skip_null: bool = True) -> DataFrame:
    """Keys that occur more than once; with ``skip_null``, only keys without a null part."""
    rows = df.where(" and ".join(f"{k} is not null" for k in key)) if skip_null else df
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def unreferenced(files: DataFrame, tokens: DataFrame, key: str = "image_name") -> DataFrame:
    return files.select(key).distinct().join(tokens.select(key), key, "left_anti")


def outside_scope(requested: DataFrame, allowed: DataFrame, key: str = "image_id") -> DataFrame:
    """Requested keys that are not allowed; a caller stops if there are any."""
    return requested.select(key).distinct().join(allowed.select(key), key, "left_anti")


def require_scope(requested: DataFrame, allowed: DataFrame, key: str = "image_id") -> None:
    if not outside_scope(requested, allowed, key).isEmpty():
        raise ValueError(f"requested {key} outside the allowed scope")


def bad_spans(mentions: DataFrame) -> Column:
    """Whether a mention's span misses its own text."""
    fits = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.length("text"))
    same = F.col("text").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("raw_value")
    return ~F.coalesce(fits & same, F.lit(False))


def ownership(mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mentions with the reason why their evidence does not own them; null where it does."""
    known = evidence.select("evidence_id", F.col("case_id").alias("__case"), F.col("fir_id").alias("__fir"))
    joined = mentions.join(known, "evidence_id", "left")
    reason = F.when(F.col("__case").isNull(), "evidence_missing").when(F.col("__case") != F.col("case_id"), "case_mismatch").when(F.col("fir_id").isNotNull() & ~F.col("fir_id").eqNullSafe(F.col("__fir")), "fir_mismatch")
    return joined.withColumn("ownership_reason", reason).drop("__case", "__fir")


def identifier_ownership(identifiers: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Identifiers (entity_key, evidence_id) whose evidence is missing or belongs to another case than their entity, with the reason."""
    rows = identifiers.join(evidence.select("evidence_id", F.col("case_id").alias("__case")), "evidence_id", "left").join(entities.select("entity_key", F.col("case_id").alias("__entity_case")), "entity_key")
    reason = F.when(F.col("__case").isNull(), "evidence_missing").when(F.col("__case") != F.col("__entity_case"), "case_mismatch")
    return rows.withColumn("ownership_reason", reason).where("ownership_reason is not null").drop("__entity_case", "__case")


def field_rules(df: DataFrame, max_length: dict[str, int] | None = None, positive: tuple[str, ...] = (), unit: tuple[str, ...] = (), required: tuple[str, ...] = (), domain: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Declarative field constraints as a ``violations`` array: lengths, positive ids, [0, 1] values, required text, domains."""
    rules = [(F.length(c) > n, f"{c}:length") for c, n in (max_length or {}).items()]
    rules += [(F.col(c) <= 0, f"{c}:positive") for c in positive]
    rules += [(~F.col(c).between(0, 1), f"{c}:range") for c in unit]
    rules += [(F.coalesce(F.trim(c), F.lit("")) == "", f"{c}:required") for c in required]
    rules += [(~F.col(c).isin(*values), f"{c}:domain") for c, values in (domain or {}).items()]
    return df.withColumn("violations", reasons(rules))


def dependency_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Rows that refer to each parent, by child table: key, child, n_rows (only where there are any)."""
    parts = []
    for name, (child, columns) in children.items():
        refs = reduce(DataFrame.unionByName, (child.select(F.col(c).alias(key)) for c in columns)).where(f"{key} is not null")
        parts.append(refs.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).select(key, F.lit(name).alias("child"), "n_rows"))
    return reduce(DataFrame.unionByName, parts).join(parents.select(key).distinct(), key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return child.where(f"{key} is not null").join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti")


def unsupported_types(mentions: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """How many mentions each type outside the ``domain`` has."""
    return mentions.where(~F.coalesce(F.col("entity_type").isin(*domain), F.lit(False))).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_mentions"))


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; None asks for nothing."""
    return df.where(reduce(Column.__and__, (F.col(c) == v for c, v in wanted.items() if v is not None), F.lit(True)))
