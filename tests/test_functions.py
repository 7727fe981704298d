from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casenet.functions import taxonomy, text


def value(spark, expression, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "normal"), [("Si Arun Testman", "Arun Testman"), ("DR. ARUN TESTMAN", "Arun Testman"), ("Q.Z. Testman", "Q.Z. Testman"), ("q.z. testman", "Q.Z. Testman"), ("Smt  Si  maria", "Maria"), ("", ""), ("Si", "Si"), ("McTest van", "McTest Van")])
def test_person_name(spark, raw, normal):
    assert value(spark, text.person_name(F.col("t")), t=raw) == normal


@pytest.mark.parametrize(("raw", "normal"), [("Airport ", "Airport Police Station"), ("Baguiati P.S", "Baguiati Police Station"), ("(north) o'neil a-b 4th", "(North) O'Neil A-B 4Th Police Station"), ("P.S", "P.S"), ("x ps,", "X Police Station"), ("", "")])
def test_police_station(spark, raw, normal):
    assert value(spark, text.police_station(F.col("t")), t=raw) == normal


@pytest.mark.parametrize(("raw", "normal"), [("420/406/120B Ipc", "IPC_420 | IPC_406 | IPC_120B"), ("399/402 Ipc And 25(I)(A)/27 Arms Act", "IPC_399 | IPC_402 | ARMS ACT_25(I)(A) | ARMS ACT_27"), ("under rule 20", "under rule 20"), ("5 Disaster Management Act 2005", "DISASTER MANAGEMENT ACT 2005_5")])
def test_statute(spark, raw, normal):
    assert value(spark, text.statute(F.col("t")), t=raw) == normal


@pytest.mark.parametrize("name", ["Si Arun Testman", "Q.Z. Testman", "Md. Test"])
def test_plausible(spark, name):
    assert value(spark, text.plausible_name(F.col("t")), t=name)


@pytest.mark.parametrize("name", ["", "  ", "2018", "12345", "---", "!@#$", "A", "P.", "Dr.", "420/406/120B Ipc", "25(I)(A)/27 Arms Act", "Airport P.S", "Baguiati Police Station", None])
def test_implausible(spark, name):
    assert value(spark, text.plausible_name(F.col("t")), t=name) is False


def test_collapse_space_is_unicode(spark):
    assert value(spark, text.collapse_space(F.col("t")), t=" a  b\x1c c\u0085 ") == "a b c"


def test_core_and_its_start(spark):
    assert value(spark, text.core(F.col("t")), t="  ab c \n") == "ab c"
    assert value(spark, text.core_start(F.col("t")), t="  ab c \n") == 2
    assert value(spark, text.core_start(F.col("t")), t="\U0001f600 x") == 0
    assert value(spark, text.core_start(F.col("t")), t="  ") is None


def test_section_identifiers_of_the_wider_act_list(spark):
    found = value(spark, text.section_identifiers(F.col("t")), t="12,a ipc & 5 Electricity Act 2003")
    assert [(i["identifier_type"], i["normalized_value"]) for i in found] == [("IPC_SECTION", "IPC_12"), ("IPC_SECTION", "IPC_A"), ("ELECTRICITY ACT 2003_SECTION", "ELECTRICITY ACT 2003_5")]


@pytest.mark.parametrize(("name", "kind"), [("a%20b.jpg", "encoded-or-ambiguous"), ("dir/Town PS12__3.jpg", "station-plus-numeric-token"), ("Town PS AB-2019-12345.jpg", "station-code-year-number-like"), ("town ps x.png", "station-plus-other-token"), ("scan.png", "no-recognized-PS-pattern")])
def test_name_pattern(spark, name, kind):
    assert value(spark, text.name_pattern(F.col("t")), t=name) == kind


def test_confidence(spark):
    row = spark.range(1).select(text.fused_confidence(F.lit(0.5891), F.lit(0.92)).alias("a"), text.fused_confidence(F.lit(9.0), F.lit(9.0)).alias("b")).first()
    assert row["a"] == pytest.approx(0.8207, abs=1e-4)
    assert row["b"] == 1.0


def test_maps(spark):
    for kind, out in (("POLICE_STATION", "Location"), ("STATUTE", "CaseRef"), ("PERSON", "Person"), ("?", "CaseRef")):
        assert value(spark, taxonomy.graph_type(F.col("t")), t=kind) == out
    for name, out in (("owns", "OWNS"), ("USES", "COMMUNICATED_WITH"), ("visited", "LOCATED_AT"), ("transaction", "TRANSFERRED_TO"), ("associated_with", "ASSOCIATED_WITH"), ("x", "ASSOCIATED_WITH")):
        assert value(spark, taxonomy.relation_type(F.col("t")), t=name) == out
    for tier, out in ((" high ", "HIGH"), ("critical", "CRITICAL"), ("odd", "LOW")):
        assert value(spark, taxonomy.risk_level(F.col("t")), t=tier) == out


def test_json_helpers(spark):
    assert value(spark, text.replace_description(F.col("m"), F.col("d")), m='{"a":"1","description":"old"}', d="new") == '{"a":"1","description":"new"}'
    assert value(spark, text.reasons_payload(F.col("r"), F.col("s")), r='{"k":1}', s=None) == '{"k":1}'
    assert value(spark, text.reasons_payload(F.col("r"), F.col("s")), r="plain", s=None) == '{"raw_reasons":"plain"}'
    assert value(spark, text.reasons_payload(F.col("r"), F.col("s")), r=None, s="sum") == '{"summary":"sum"}'
