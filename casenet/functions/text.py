"""Text rules as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a title, an act, or a legal word in such records.
NORMALIZER_TITLES = r"Sri|Smt|Smti|Md\.|Mohd\.?|Dr\.|Mr\.|Mrs\.|Miss|Si|S\.I\.|Asi|A\.S\.I\.|Inspector|Constable"
CHECKER_TITLES = r"Sri|Smt|Smti|Md\.|Mohd\.?|Dr\.|Dr|Mr\.|Mr|Mrs\.|Mrs|Miss|Si|S\.I\.|Asi|A\.S\.I\.|Inspector|Constable"
LEGAL_WORDS = r"Ipc|Act|Section|Sec|CrPC|P\.S\.?|PS|Police\s+Station"
STATION_WORDS = r"P\.S\.?|PS|Police\s+Station"
NORMALIZER_ACTS = r"Ipc|Arms\s+Act|Electricity\s+Act|Disaster\s+Management\s+Act.*"
IDENTIFIER_ACTS = r"Ipc|Arms\s+Act|Electricity\s+Act.*"
CLAUSE_JOINT = r"(?iU)\s+(?:and|&)\s+"
SECTIONS = r"[\d\w/(),\s]+?"

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse_space(text: Column) -> Column:
    """Each run of (Unicode) white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def core(text: Column) -> Column:
    """The text from its first to its last non-space character on one line; empty if there is none."""
    return F.regexp_extract(text, r"(?dU)\S.*\S|\S", 0)


def core_start(text: Column) -> Column:
    """0-based code-point position of ``core``; null if there is none."""
    return F.when(core(text) != "", F.instr(text, core(text)) - 1)


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def title_case(text: Column) -> Column:
    """Every run of letters with its first letter upper and the others lower, other characters as they are."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), capitalized), "")


def person_name(raw: Column) -> Column:
    """Titles in front go, initials are upper, words all upper or all lower are capitalised, mixed ones stay."""
    clean = collapse_space(raw)
    bare = F.trim(F.regexp_replace(clean, rf"(?iU)^(?:(?:{NORMALIZER_TITLES})\s+)+", ""))
    bare = F.when(bare == "", clean).otherwise(bare)

    def word(w: Column) -> Column:
        letters = w.rlike(r"\p{L}")
        return (
            F.when(w.rlike(r"^[A-Za-z]\.(?:[A-Za-z]\.)*$"), F.upper(w))
            .when(w.rlike(r"^[A-Z]{2,}$") | (letters & (F.lower(w) == w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
            .otherwise(w)
        )

    return F.when(clean == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(bare, " "), word), " "))


def police_station(raw: Column) -> Column:
    """The place name in title case with one standard suffix; the trimmed text if nothing but the suffix stands there."""
    clean = collapse_space(raw)
    bare = F.regexp_replace(clean, r"[,.\-_]+$", "")
    bare = collapse_space(F.regexp_replace(bare, rf"(?iU)\b(?:{STATION_WORDS})\b", ""))
    return F.when(clean == "", F.lit("")).when(bare == "", F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")).otherwise(F.concat(title_case(bare), F.lit(" Police Station")))


def _clauses(text: Column) -> Column:
    return F.transform(F.split(text, CLAUSE_JOINT), lambda c: F.trim(c))


def _act(clause: Column, acts: str) -> Column:
    """Act and section list of a clause as a struct; null act if the clause has another form."""
    pattern = rf"(?iU)^({SECTIONS})\s+({acts})$"
    act = F.regexp_extract(clause, pattern, 2)
    name = F.when(act.rlike(r"(?i)^ipc\.?$"), F.lit("IPC")).otherwise(F.upper(collapse_space(act)))
    sections = F.filter(F.transform(F.split(F.regexp_extract(clause, pattern, 1), "[/,]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.struct(F.when(act != "", name).alias("act"), sections.alias("sections"), clause.alias("clause"))


def statute(raw: Column) -> Column:
    """``ACT_SECTION`` for each section, joined by `` | ``; a clause of another form stays as it is."""
    clean = collapse_space(raw)

    def clause(c: Column) -> Column:
        parsed = _act(c, NORMALIZER_ACTS)
        return F.when(parsed["act"].isNull() | (F.size(parsed["sections"]) == 0), F.array(c)).otherwise(F.transform(parsed["sections"], lambda s: F.concat(parsed["act"], F.lit("_"), F.upper(s))))

    return F.when(clean == "", F.lit("")).otherwise(F.array_join(F.flatten(F.transform(_clauses(clean), clause)), " | "))


def section_identifiers(raw: Column) -> Column:
    """Sections of a statute text as ``array<struct<identifier_type, identifier_value, normalized_value, confidence>>``."""

    def clause(c: Column) -> Column:
        parsed = _act(c, IDENTIFIER_ACTS)
        one = lambda s: F.struct(F.concat(parsed["act"], F.lit("_SECTION")).alias("identifier_type"), s.alias("identifier_value"), F.concat(parsed["act"], F.lit("_"), F.upper(s)).alias("normalized_value"), F.lit(0.98).alias("confidence"))
        return F.when(parsed["act"].isNotNull(), F.transform(parsed["sections"], one)).otherwise(F.array().cast("array<struct<identifier_type:string,identifier_value:string,normalized_value:string,confidence:double>>"))

    return F.flatten(F.transform(_clauses(core(raw)), clause))


def plausible_name(text: Column) -> Column:
    """Whether a text can be a person's name: letters, no legal word, and a real word or initial behind its titles."""
    clean = collapse_space(text)
    bare = F.trim(F.regexp_replace(clean, rf"(?iU)^(?:(?:{CHECKER_TITLES})(?:\s+|$))+", ""))
    token = F.exists(F.split(bare, " "), lambda t: t.rlike(r"[A-Za-z]{2,}") | t.rlike(r"^[A-Za-z]\.$"))
    return F.coalesce(~clean.rlike(rf"(?iU)\b(?:{LEGAL_WORDS})\b") & (F.regexp_count(bare, F.lit("[A-Za-z]")) >= 2) & token, F.lit(False))


def fused_confidence(ocr: Column, extraction: Column, ocr_weight: float = 0.30, extraction_weight: float = 0.70) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ocr_weight * ocr + extraction_weight * extraction)), 4)


def document_number(image_id: Column) -> Column:
    return F.concat(F.lit("ICDAR-"), image_id.cast("string"))


def name_pattern(file_name: Column) -> Column:
    """Class of an image file name; the first that fits (classes and patterns are fixed values)."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), r"__\d+$", "")
    return (
        F.when(stem.contains("%20"), "encoded-or-ambiguous")
        .when(stem.rlike(r"(?i)^.+\s+PS\d+$"), "station-plus-numeric-token")
        .when(stem.rlike(r"(?i)^.+\s+PS.+-\d{2,4}-\d{3,5}$"), "station-code-year-number-like")
        .when(stem.rlike(r"(?i)^.+\s+PS.+$"), "station-plus-other-token")
        .otherwise("no-recognized-PS-pattern")
    )


def storage_key(image_id: Column, sha256: Column) -> Column:
    return F.concat(F.lit("fir_dataset_"), image_id.cast("string"), F.lit("_"), F.substring(sha256, 1, 16), F.lit(".jpg"))


def edge_description(evidence: Column, documents: Column, weight: Column) -> Column:
    return F.concat(evidence, F.lit(" | source_firs="), F.array_join(documents, ","), F.lit(" | weight="), weight.cast("string"))


def joined_reasons(reasons: Column) -> Column:
    """The reasons in one text, or a fixed sentence."""
    return F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise("Single appearance in network with low risk indicators.")


def reasons_payload(reasons: Column, summary: Column) -> Column:
    """The reasons if they are JSON, else wrapped as raw text, else the summary wrapped, as JSON text."""
    parsed = F.try_parse_json(reasons)
    return F.when(F.coalesce(reasons, F.lit("")) != "", F.coalesce(F.to_json(parsed), F.to_json(F.struct(reasons.alias("raw_reasons"))))).when(F.coalesce(summary, F.lit("")) != "", F.to_json(F.struct(summary.alias("summary")))).otherwise("{}")


def replace_description(metadata: Column, description: Column) -> Column:
    """A JSON object with its ``description`` replaced and all other keys kept, with their types; what is no object counts as empty."""
    old = F.coalesce(F.from_json(metadata, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    rest = F.map_filter(old, lambda k, _: k != "description")
    return F.to_json(F.when(description.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("description"), description.cast("variant")))))
