from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from casenet.functions import text
from casenet.operators import crossval, extract, graph, layout, profile, report, resolve, validate
from casenet.plans import case_tables
from casenet.sources import scans, sinks
from casenet.streaming import append_stream

TOKEN = "image_id bigint, image_name string, source_index int, x1 double, y1 double, x2 double, y2 double, score double, category_id int, text string"


def token(**change):
    row = {"image_id": 7, "image_name": "a.jpg", "source_index": 0, "x1": 1.0, "y1": 1.0, "x2": 2.0, "y2": 2.0, "score": 0.9, "category_id": 3, "text": "x"} | change
    return tuple(row.values())


def test_annotations_are_scanned_and_typed(spark, tmp_path):
    good = {"bbox": [1, 2, 3, 4.5], "category_id": 3, "image_id": 7, "image_name": "a.jpg", "score": 0.5, "text": "x"}
    rows = [good, good | {"image_id": True}, good | {"bbox": [1, 2, 3]}, good | {"text": 5}, good | {"more": 1}, good | {"score": 1.2}, good | {"bbox": [5, 2, 3, 4]}]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    checked = validate.check_tokens(validate.typed_record(scans.read_annotation_array(spark, str(tmp_path / "in.json"))))
    found = {r["source_index"]: r["violations"] for r in checked.collect()}
    assert found == {0: [], 1: ["image_id"], 2: ["bbox"], 3: ["text"], 4: ["fields"], 5: ["score"], 6: ["reversed_bbox"]}


def test_an_array_is_scanned_in_ranges(spark, tmp_path):
    """Braces and quotes in strings, nested values, records over several ranges, and a file that is cut off."""
    rng = random.Random(3)
    rows = [{"a": i, "t": rng.choice(['x } {" \\" y', "plain", "{{{", 'é"}]', "\\\\", "a\nb", ""]), "bbox": [1, 2, {"n": {"d": "}"}}], "m": {"z": []}} for i in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n[\n" + ",\n ".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows)) + " ]\n")
    (tmp_path / "in/b.json").write_text("[]")
    (tmp_path / "in/c.json").write_text(json.dumps(rows[:3]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = scans.read_annotation_array(spark, str(tmp_path / "in")).select("source_index", F.to_json("record").alias("r")).collect()
        for cut in ('[{"a": 1}, {"a":', '[{"a": 1}, {"a":2', '[{"a": 1}'):
            (tmp_path / "cut.json").write_text(cut)
            with pytest.raises(Exception, match="does not end behind a record"):
                scans.read_annotation_array(spark, str(tmp_path / "cut.json")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda x: (x[0], json.dumps(x[1]))
    assert sorted(((r["source_index"], json.loads(r["r"])) for r in found), key=key) == sorted([*enumerate(rows), *enumerate(rows[:3])], key=key)


def test_ids_of_a_list_are_digits():
    assert scans.parse_ids(" 3, 10,,2 ") == [3, 10, 2] and scans.parse_ids(None) is None and scans.parse_ids(" ") is None
    for text_of_ids in ("1,x", "-1", "1.5", "²"):
        with pytest.raises(ValueError):
            scans.parse_ids(text_of_ids)


def test_types_outside_the_domain_are_counted(spark):
    rows = spark.createDataFrame([("PERSON",), ("PHONE",), ("PHONE",), (None,)], "entity_type string")
    assert {(r["entity_type"], r["n_mentions"]) for r in validate.unsupported_types(rows, ("PERSON",)).collect()} == {("PHONE", 2), (None, 1)}


def test_every_requested_image_is_accounted_for(spark):
    odd = {2: '{"dataset_image_id":2}', 3: "[1,2]", 4: "5", 5: '{"ocr_records":"x"}', 6: "{broken", 7: '{"ocr_records":[]}', 8: json.dumps({"ocr_records": [{"source_index": 0, "score": 0.9, "category_id": 0, "original_text": "X PS"}]})}
    firs = spark.createDataFrame([(i, i, 1) for i in range(1, 9)], "image_id bigint, fir_id bigint, case_id bigint")
    proof = spark.createDataFrame([(i, i, 1, t) for i, t in odd.items()], "evidence_id bigint, fir_id bigint, case_id bigint, metadata_text string")
    asked = spark.createDataFrame([(i,) for i in range(10)], "image_id bigint")
    mentions, rejections = extract.extraction_job(asked, firs, proof)
    assert [(r["image_id"], r["raw_value"]) for r in mentions.collect()] == [(8, "X PS")]
    bare = "metadata_without_records"
    assert {r["image_id"]: r["reason"] for r in rejections.collect()} == {0: "fir_missing", 9: "fir_missing", 1: "evidence_missing", 2: bare, 3: bare, 4: bare, 5: bare, 6: "metadata_unreadable"}
    row = extract.extraction_report(asked, firs, proof).first().asDict()
    assert (row["n_requested"], row["n_processed"], row["n_rejected_images"], row["n_without_records"], row["n_records"], row["n_mentions"]) == (10, 2, 8, 1, 1, 1)


def test_a_resolution_job_stays_in_its_scope_and_adds_nothing_twice(spark, tmp_path):
    rows = gold(spark).withColumns({"start_char": F.lit(0), "end_char": F.length("raw_value"), **{c: F.lit(1.0) for c in ("x1", "y1", "x2", "y2", "ocr_confidence", "extraction_confidence")}, "category_id": F.lit(3), "low_ocr_confidence": F.lit(False), "extraction_method": F.lit("m"), "extractor_version": F.lit("1")})
    proof = rows.select("evidence_id", "case_id", "fir_id").distinct()
    images, path = rows.select("image_id"), str(tmp_path / "store")
    first = resolve.resolution_job(rows, proof, path, images.where("image_id <> 3"), images)[1].first()
    again = resolve.resolution_job(rows, proof, path, images.where("image_id <> 3"), images)[1].first()
    assert (first["n_appended"], again["n_appended"]) == (5, 0) and first["n_mentions"] == 9
    with pytest.raises(ValueError, match="scope"):
        resolve.resolution_job(rows, proof, path, images, images.where("image_id <> 3"))


def test_quarantine_loses_no_row(spark):
    rows = spark.createDataFrame([token(), token(score=None), token(x2=0.0), token(text=" "), token(image_name="b/c.jpg")], TOKEN)
    good, bad = validate.split(validate.missing_images(validate.check_tokens(rows), spark.createDataFrame([("a.jpg",)], "image_name string")))
    assert (good.count(), bad.count()) == (2, 3)
    assert good.where("size(warnings) = 1").count() == 1
    assert [r["violations"] for r in bad.where("image_name = 'b/c.jpg'").collect()] == [["image_name", "missing_image"]]


def test_reading_order_golden(spark):
    rows = [token(source_index=0, x1=10.0, y1=10.0, x2=40.0, y2=25.0, text="top"), token(source_index=1, x1=10.0, y1=40.0, x2=50.0, y2=60.0, text=" left  "), token(source_index=2, x1=100.0, y1=40.0, x2=150.0, y2=60.0, text="right")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        ordered = layout.reading_order(spark.createDataFrame(rows, TOKEN))
        assert layout.reconstructed_text(ordered).first()["extracted_text"] == "top left right"
        assert [r["text"] for r in ordered.orderBy("reconstructed_order").collect()] == ["top", " left  ", "right"]


def lines_of(tokens):
    """Plain statement of the reading order on (index, x1, y1, x2, y2) rows."""
    heights = sorted(t[4] - t[2] for t in tokens)
    middle = len(heights) // 2
    reach = max(2.0, 0.5 * (heights[middle] if len(heights) % 2 else (heights[middle - 1] + heights[middle]) / 2))
    lines = []
    for t in sorted(tokens, key=lambda t: ((t[2] + t[4]) / 2, t[1], t[0])):
        centre = (t[2] + t[4]) / 2
        means = [sum((u[2] + u[4]) / 2 for u in line) / len(line) for line in lines]
        near = [(abs(m - centre), i) for i, m in enumerate(means) if abs(m - centre) <= reach]
        if near:
            lines[min(near)[1]].append(t)
        else:
            lines.append([t])
    lines.sort(key=lambda line: (sum((u[2] + u[4]) / 2 for u in line) / len(line), min(u[1] for u in line)))
    return [t[0] for line in lines for t in sorted(line, key=lambda t: (t[1], t[2], t[0]))]


def test_reading_order_against_brute_force(spark):
    rng, rows, want = random.Random(5), [], {}
    for image in range(40):
        boxes = []
        for i in range(rng.randint(1, 14)):
            x, y = float(rng.randint(0, 60)), float(rng.randint(0, 60))
            boxes.append((i, x, y, x + rng.randint(1, 20), y + rng.randint(2, 16)))
        want[image] = lines_of(boxes)
        rows += [token(image_id=image, source_index=i, x1=a, y1=b, x2=float(c), y2=float(d)) for i, a, b, c, d in boxes]
    got = layout.reading_order(spark.createDataFrame(rows, TOKEN)).orderBy("image_id", "reconstructed_order").collect()
    assert {i: [r["source_index"] for r in got if r["image_id"] == i] for i in want} == want


def test_composite_split_and_spans(spark):
    texts = ["Si Arun Kumar Testman, Baguiati P.S", "   Si Arun Testman, X PS ", "Airport P.S", "2018", None, ", Chips Lane"]
    rows = spark.createDataFrame([token(source_index=i, text=t) for i, t in enumerate(texts)], TOKEN)
    found = extract.extract_mentions(rows)
    got = [(r["source_index"], r["entity_type"], r["raw_value"], r["start_char"], r["end_char"], r["extraction_confidence"]) for r in found.orderBy("source_index", "span_index").collect()]
    assert got == [(0, "PERSON", "Si Arun Kumar Testman", 0, 21, 0.90), (0, "POLICE_STATION", "Baguiati P.S", 23, 35, 0.92), (1, "PERSON", "Si Arun Testman", 3, 18, 0.90), (1, "POLICE_STATION", "X PS", 20, 24, 0.92), (5, "POLICE_STATION", "Chips Lane", 2, 12, 0.92)]
    assert extract.rejected(found).count() == 0


RESOLVE = "case_id bigint, fir_id bigint, evidence_id bigint, image_id bigint, source_index int, span_index int, entity_type string, raw_value string, normalized_value string, final_confidence double"
GOLD = [(1, 10, "PERSON", "John Doe"), (1, 10, "PERSON", "john doe"), (1, 20, "PERSON", "John Doe"), (1, 20, "PERSON", "John Doe"), (1, 10, "POLICE_STATION", "X PS"), (1, 20, "POLICE_STATION", "X PS"), (2, 30, "PERSON", "John Doe"), (1, 10, "PERSON", "A"), (1, 10, "IDENTIFIER", "ABC"), (1, 10, "PERSON", "John Doe")]


def gold(spark):
    return spark.createDataFrame([(c, f, f, i, 0, 0, t, n, n, 0.9) for i, (c, f, t, n) in enumerate(GOLD, 1)], RESOLVE)


def test_resolution_table(spark):
    got = resolve.resolve(gold(spark)).orderBy("image_id").collect()
    assert [r["decision"] for r in got] == ["CREATED_NEW", "MATCHED_EXISTING_SAME_FIR", "KEPT_SEPARATE_CROSS_FIR", "KEPT_SEPARATE_CROSS_FIR", "CREATED_NEW", "MATCHED_EXISTING_CROSS_FIR", "CREATED_NEW", "KEPT_SEPARATE_AMBIGUOUS", "KEPT_SEPARATE_AMBIGUOUS", "MATCHED_EXISTING_SAME_FIR"]
    keys = [r["entity_key"] for r in got]
    assert keys[0] == keys[1] == keys[9] != keys[2] == keys[3]
    assert keys[4] == keys[5]
    assert keys[7] is None and keys[8] is None
    assert len({k for k in keys if k}) == 4


def odd_mentions(spark):
    """Mentions with null parts, unknown types and repeated coordinates."""
    rng = random.Random(3)
    rows = [
        (rng.choice([1, 2, None]), rng.choice([10, 20, None]), rng.choice([5, 6, None]), rng.randrange(40), rng.randrange(2), rng.randrange(2), rng.choice(["PERSON", "STATUTE", "OTHER", "NONE", None]), rng.choice([" John Doe", "john doe", "X "]),
            rng.choice(["John Doe", "john doe ", " ", "x|1", "A", None]), rng.choice([0.5, 0.9, None]), rng.randrange(2), rng.randrange(2, 4)) for _ in range(400)
    ]
    rows = spark.createDataFrame(rows, RESOLVE + ", start_char int, end_char int")
    return rows.withColumns({c: F.lit(None).cast("double") for c in ("ocr_confidence", "extraction_confidence", "x1", "y1", "x2", "y2")} | {c: F.lit("v") for c in ("extraction_method", "extractor_version")} | {"low_ocr_confidence": F.lit(False), "category_id": F.lit(0)})


@pytest.mark.parametrize("merge_persons", [False, True])
def test_keys_entities_and_links_without_resolutions(spark, merge_persons):
    rows = odd_mentions(spark).drop_duplicates(["image_id", "source_index", "span_index"])
    resolved = resolve.resolve(rows, merge_persons)
    everything = lambda df, *columns: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    digested = F.lower(F.hex(resolve.digest(F.col("entity_key")))).alias("entity_key")
    place = ("image_id", "source_index", "span_index")
    assert everything(resolve.keyed(rows, merge_persons), *place, digested) == everything(resolved, *place, "entity_key")
    columns = [c for c in resolve.entities(resolved).columns if c != "entity_key"]
    want = everything(resolve.entities(resolved), "entity_key", *columns)
    assert len(want) > 10 and everything(resolve.entities_of(rows, merge_persons), F.lower(F.hex("entity_key")).alias("entity_key"), *columns) == want
    whole = resolve.provenance(resolved)
    key = resolve.mention_key(*map(F.col, resolve.PLACE)).alias("mention_key")
    assert whole.count() < resolved.where("entity_key is not null").count()
    assert everything(resolve.provenance_links(rows, merge_persons), key, F.lower(F.hex("entity_key")).alias("entity_key"), *resolve.PLACE) == everything(whole, "mention_key", "entity_key", *resolve.PLACE)


def test_resolution_does_not_depend_on_row_order_or_partitions(spark):
    plain = sorted(map(str, resolve.resolve(gold(spark)).select("image_id", "decision", "entity_key").collect()))
    assert sorted(map(str, resolve.resolve(gold(spark).repartition(5, "raw_value").orderBy(F.desc("image_id"))).select("image_id", "decision", "entity_key").collect())) == plain


def decided(df):
    return [(r["decision"], r["entity_key"], r["entity_name"], r["reason"]) for r in df.orderBy("image_id").collect()]


@pytest.mark.parametrize("merge_persons", [False, True])
def test_incremental_resolution_reads_entities_and_decides_as_a_whole_run(spark, merge_persons):
    rows = gold(spark)
    state = resolve.EntityState(spark, buckets=2, merge_persons=merge_persons)
    for name, part in (("a", "image_id <= 2"), ("b", "image_id between 3 and 6"), ("c", "image_id > 6")):
        got = decided(resolve.resolve_incremental(state, rows.where(part), name))
        assert got == decided(resolve.resolve(rows, merge_persons).where(part))
    stored = sorted(map(tuple, state.read().collect()), key=str)
    assert len(stored) == (3 if merge_persons else 4)
    assert decided(resolve.resolve_incremental(state, rows.where("image_id between 3 and 6"), "b")) == decided(resolve.resolve(rows, merge_persons).where("image_id between 3 and 6"))
    assert sorted(map(tuple, state.read().collect()), key=str) == stored
    state.close()
    again = resolve.EntityState(spark, state.path)
    assert sorted(map(tuple, again.read().collect()), key=str) == stored and again.merge_persons == merge_persons
    plan = again.known(spark.createDataFrame([("x",)], "group_key string"))._jdf.queryExecution().toString()
    assert "image_id" in plan and "span" in plan
    again.delete()


def test_a_batch_that_failed_leaves_the_state_as_it_was(spark, monkeypatch):
    rows, state = gold(spark), resolve.EntityState(spark, buckets=2)
    resolve.resolve_incremental(state, rows.where("image_id <= 2"), "a")
    with monkeypatch.context() as patched:
        patched.setattr(state.manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            resolve.resolve_incremental(state, rows.where("image_id > 2").withColumn("raw_value", F.lit("half")), "b")
    again = resolve.EntityState(spark, state.path)
    assert list(again.batches()) == ["a"] and again.read().count() == 1
    assert decided(resolve.resolve_incremental(again, rows.where("image_id > 2"), "b")) == decided(resolve.resolve(rows).where("image_id > 2"))
    assert again.read().where("raw_value = 'half'").count() == 0
    again.delete()


def test_append_is_idempotent_with_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, None, "c")], "k bigint, n bigint, v string")
    path = str(tmp_path / "out")
    assert sinks.append_new(rows, path, "k", "n").count() == 2
    assert sinks.append_new(rows, path, "k", "n").count() == 0
    assert spark.read.parquet(path).count() == 2


def test_the_row_that_is_stored_is_the_least(spark, tmp_path):
    rows = [(1, "b", [2]), (1, "a", [9]), (None, "z", [1]), (None, "y", [3])]
    for part in (rows, rows[::-1]):
        once = sinks.one_of_each(spark.createDataFrame(part, "k bigint, v string, more array<int>").repartition(3, "v"), "k")
        assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", [9]), (None, "y", [3])]


def test_publish_follows_the_order_of_publishing(spark, tmp_path):
    root = str(tmp_path / "pub")
    for run in ("run-9", "run-10", "run-9"):
        sinks.publish(spark, {"t": spark.createDataFrame([(run,)], "v string")}, root, run)
    assert [r["v"] for r in sinks.read_published(spark, root, "t").collect()] == ["run-10"]
    assert [r["v"] for r in sinks.read_published(spark, root, "t", "run-9").collect()] == ["run-9"]


def test_a_failure_between_two_tables_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "pub")
    good = lambda v: {t: spark.createDataFrame([(v,)], "v string") for t in ("a", "b")}
    with pytest.raises(ValueError):
        sinks.read_published(spark, root, "a")
    sinks.publish(spark, good("1"), root, "r1")
    broken = {"a": good("2")["a"], "b": good("2")["b"].withColumn("v", F.raise_error("lost"))}
    with pytest.raises(Exception, match="lost"):
        sinks.publish(spark, broken, root, "r2")
    assert {t: [r["v"] for r in sinks.read_published(spark, root, t).collect()] for t in "ab"} == {"a": ["1"], "b": ["1"]}
    sinks.publish(spark, good("2"), root, "r2")
    (tmp_path / "pub/_manifest/000000000099.json").write_text('{"run_id"')  # a writer that died
    assert {t: [r["v"] for r in sinks.read_published(spark, root, t).collect()] for t in "ab"} == {"a": ["2"], "b": ["2"]}
    assert len(sinks.sweep(spark, root)) >= 1 and sinks.sweep(spark, root) == []
    sinks.publish(spark, good("3"), root, "r3")
    assert [r["v"] for r in sinks.read_published(spark, root, "b").collect()] == ["3"]


def test_import_status(spark):
    images = spark.createDataFrame([(i, 1, "h", "a", "d") for i in range(7)], "image_id bigint, case_id bigint, image_sha256 string, archive_sha256 string, dataset_name string")
    firs = spark.createDataFrame([(i + 100, 2 if i == 1 else 1, i) for i in range(1, 7)], "fir_id bigint, case_id bigint, image_id bigint")
    meta = lambda i: json.dumps({"dataset_name": "d", "archive_sha256": "a", "dataset_image_id": i})
    proof = spark.createDataFrame([(103, "h", meta(3)), (104, "other", meta(4)), (105, "h", meta(5)), (105, "h", meta(5)), (106, "h", "{broken")], "fir_id bigint, file_hash string, metadata_text string")
    plan = profile.import_plan(images, firs, proof)
    assert [r["status"] for r in plan.orderBy("image_id").collect()] == ["PROPOSED", "CONFLICT", "RESUMED", "ALREADY_IMPORTED", "CONFLICT", "CONFLICT", "CONFLICT"]
    assert profile.status_counts(plan).where("status = 'PROPOSED'").count() == 0


def test_references(spark):
    firs = spark.createDataFrame([(500, 0, "ICDAR-0"), (501, None, "X/1")], "fir_id bigint, image_id bigint, fir_number string")
    refs = spark.createDataFrame([("500",), ("FIR-500",), ("ICDAR-0",), ("icdar-0",), ("0",), ("X/1",), ("FIR-999999",), ("",), (None,)], "ref string")
    got = {r["ref"]: r["fir_id"] for r in crossval.resolve_references(refs, firs).collect()}
    assert got == {"500": 500, "FIR-500": 500, "ICDAR-0": 500, "icdar-0": 500, "0": 500, "X/1": 501, "FIR-999999": None, "": None, None: None}


def test_fuzzy_groups(spark):
    names = spark.createDataFrame([("PERSON", "Alexander Testman"), ("PERSON", "Alexander Testmann"), ("PERSON", "alexandor testmann"), ("PERSON", "Someone Else"), ("STATUTE", "Alexander Testman")], "entity_type string, normalized_name string").withColumnRenamed("normalized_name", "normalized_value")
    groups = crossval.fuzzy_groups(names.withColumnRenamed("normalized_value", "normalized_name"))
    assert {(r["name"], r["group_name"]) for r in groups.collect()} == {(n, "alexander testman") for n in ("alexander testman", "alexander testmann", "alexandor testmann")}


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_groups_against_brute_force(spark):
    rng, rows = random.Random(11), {("N", f"unit number {k:05d}") for k in range(0, 60, 2)} | {("N", f"unit number {k:05d}") for k in range(90000, 90010)}
    rows |= {("E", "same beginning"), ("E", "same beginning x"), ("E", "same beginning y"), ("T", "abcdefghij"), ("T", "abcdefghix"), ("T", "abcdefghijk")}
    for _ in range(12):
        name = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 45))).strip() or "a"
        for _ in range(7):
            rows.add(("P", name))
            letters = list(name)
            for _ in range(rng.randint(1, 5)):
                k = rng.randrange(len(letters))
                letters[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"]) if len(letters) > 3 else "x"
            name = "".join(letters)
    group = {row: row for row in rows}
    similar = [(x, y) for x in rows for y in rows if x[0] == y[0] and x < y and 1 - _edit_distance(x[1], y[1]) / max(len(x[1]), len(y[1])) > 0.90]
    for _ in rows:
        before = dict(group)
        for x, y in similar:
            group[x] = group[y] = min(group[x], group[y])
        if group == before:
            break
    want = {(kind, name, group[kind, name][1]) for kind, name in {x for pair in similar for x in pair}}
    assert len({g for _, _, g in want}) > 8
    for hot_pairs in (crossval.HOT_PAIRS, 3):
        got = crossval.fuzzy_groups(spark.createDataFrame(sorted(rows), "entity_type string, normalized_name string"), hot_pairs=hot_pairs).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_names_of_one_pattern_are_grouped_without_all_their_pairs(spark, monkeypatch):
    found, near = [], crossval._near_pairs

    def counted(*args):
        pairs = near(*args)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(crossval, "_near_pairs", counted)
    names = spark.range(400).selectExpr("'S' as entity_type", "format_string('Supplier#%09d police station', id) as normalized_name")
    groups = crossval.fuzzy_groups(names).select("group_name").collect()
    assert len(groups) == 400 and {r["group_name"] for r in groups} == {"supplier#000000000 police station"}
    assert found == [0]  # all 79,800 pairs are similar


def test_triage(spark):
    alerts = spark.createDataFrame([(1, "OPEN", None), (2, "RESOLVED", 5), (3, "RESOLVED", 6)], "alert_id bigint, status string, resolved_at bigint")
    updates = spark.createDataFrame([(1, "ACKNOWLEDGED", 1), (1, "RESOLVED", 9), (2, "OPEN", 8)], "alert_id bigint, new_status string, at bigint")
    assert [tuple(r) for r in graph.triage(alerts, updates).select("alert_id", "status", "resolved_at").orderBy("alert_id").collect()] == [(1, "RESOLVED", 9), (2, "OPEN", None), (3, "RESOLVED", 6)]


def test_pages_are_bounded(spark):
    rows = spark.range(10)
    assert [tuple(r) for r in report.page(rows, [F.desc("id")], offset=2, limit=3).collect()] == [(7, 10), (6, 10), (5, 10)]
    with pytest.raises(ValueError):
        report.page(rows, [F.col("id")], limit=101)


def test_external_adapter(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"fir_id": "FIR_3", "source_image": "s", "entities": [{"id": "e1", "type": "LOCATION", "value": " Town "}, {"id": "e2", "type": "DATE", "value": "2019"}]}, {"fir_id": "odd", "source_image": "s", "entities": []}]))
    got = scans.external_entities(scans.read_external(spark, str(tmp_path / "x.json"))).collect()
    assert [(r["image_id"], r["entity_type"], r["normalized_value"]) for r in got] == [(3, "POLICE_STATION", "Town")]


def test_images_are_listed_and_hashed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"1")
    (tmp_path / "sub/b.png").write_bytes(b"2")
    (tmp_path / "c.txt").write_bytes(b"3")
    rows = {r["image_name"]: r["sha256"] for r in scans.list_images(spark, str(tmp_path), with_hash=True).collect()}
    assert set(rows) == {"a.JPG", "b.png"}
    assert rows["a.JPG"].startswith("6b86b273ff34fce1")


def test_similar_names_against_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng, rows = random.Random(5), {("S", "xa police station"), ("S", "xb police station"), ("P", "abcdefghijklmnopqrstu"), ("P", "Xbcdefghijklmnopqrst#".lower())}
    for _ in range(25):
        base = "".join(rng.choice("abcdef ") for _ in range(rng.randint(8, 34))).strip() or "a"
        for kind, tail in (("P", ""), ("S", " police station")):
            rows.add((kind, base + tail))
            for _ in range(4):
                name = list(base)
                for _ in range(rng.randint(1, 4)):
                    k = rng.choice([0, 1, len(name) - 1, rng.randrange(len(name))])
                    name[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "y"]) if len(name) > 3 else "x"
                rows.add((kind, "".join(name) + tail))
    rows |= {("H", f"{x} the very same middle of every name {y}") for x in ("aa", "ab", "abc", "zz", "azz") for y in ("one", "onw", "two", "oneone", "xxxx")}
    want = {(t, a, b) for t, a in rows for u, b in rows if t == u and a < b and 1 - distance(a, b) / max(len(a), len(b)) > 0.90}
    for hot_pairs in (crossval.HOT_PAIRS, 3):
        got = crossval.similar_names(spark.createDataFrame(sorted(rows), "entity_type string, normalized_name string"), hot_pairs=hot_pairs).collect()
        assert len(got) == len(want) and {(r["entity_type"], r["a"], r["b"]) for r in got} == want
    assert ("P", "abcdefghijklmnopqrstu", "xbcdefghijklmnopqrst#") in want


def test_streamed_rows_are_appended_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id int, v string")
    for number in (1, 2):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_stream(stream, store, str(tmp_path / "log"), "id").awaitTermination()
        assert sorted(spark.read.parquet(store).select("v").toPandas()["v"]) == ["a", "b", "c"]
    rows.union(spark.createDataFrame([(3, "d")], "id int, v string")).write.mode("append").parquet(source)
    append_stream(spark.readStream.schema(rows.schema).parquet(source), store, str(tmp_path / "other-log"), "id").awaitTermination()
    assert sorted(spark.read.parquet(store).select("v").toPandas()["v"]) == ["a", "b", "c", "d"]


def test_scope_guard(spark):
    allowed = spark.range(3).toDF("image_id")
    validate.require_scope(spark.range(2).toDF("image_id"), allowed)
    with pytest.raises(ValueError, match="scope"):
        validate.require_scope(spark.range(5).toDF("image_id"), allowed)


def test_reasons_that_are_null_or_no_json(spark):
    rows = spark.createDataFrame([(None, None, None), ([], "", ""), (["x"], "[1, ", "s"), (["x", "y"], '{"a": 1}', None)], "l array<string>, r string, s string")
    got = [tuple(r) for r in rows.select(text.joined_reasons(F.col("l")), text.reasons_payload(F.col("r"), F.col("s"))).collect()]
    default = "Single appearance in network with low risk indicators."
    assert got == [(default, "{}"), (default, "{}"), ("x", '{"raw_reasons":"[1, "}'), ("x | y", '{"a":1}')]


def test_passing_tables_go_and_others_stay(spark):
    from casenet.plans import shared

    tables, kept = shared.SharedTables(spark), shared.new_path(spark, "kept")
    spark.range(1).write.parquet(kept)
    with shared.scratch(spark):
        inner = shared.passing_path(spark, "inner")
        tables.write(spark.range(2), "t")
        spark.range(1).write.parquet(inner)
    assert not shared.exists(spark, inner) and not any(shared.exists(spark, p) for p in tables.paths["t"])
    tables.write(spark.range(2), "u")
    (path,) = tables.paths["u"]
    assert path in shared._of_session and kept not in shared._of_session
    tables.drop("u")
    assert path not in shared._of_session and not shared.exists(spark, path) and shared.exists(spark, kept)


def test_mentions_of_different_texts_are_those_of_each_token(spark, tmp_path):
    texts = ["Si John Ram, Town P.S", " Town Police  Station, ", "12/4 Ipc And 25(I)(A)/27 Arms Act", "2018", "", "  ", None, "DR. A B", "Under rule 4"]
    rows = spark.createDataFrame([(i, k, t, c, 0.5) for i, t in enumerate(texts) for c in (0, 1, 2, 3, None) for k in range(2)], "image_id bigint, source_index int, text string, category_id int, score double")
    extract.texts(rows).write.parquet(f"{tmp_path}/texts")
    different = spark.read.parquet(f"{tmp_path}/texts")
    assert different.count() == different.distinct().count() == 3 * len(texts)
    extract.text_mentions(different).write.parquet(f"{tmp_path}/parsed")
    plain = sorted(map(repr, extract.extract_mentions(rows).collect()))
    assert plain and sorted(map(repr, extract.extract_mentions(rows, parsed=spark.read.parquet(f"{tmp_path}/parsed")).select(*extract.extract_mentions(rows).columns).collect())) == plain


def test_counted_appends_add_each_key_once(spark, tmp_path):
    rows, path = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z")], "k string, n int, v string"), str(tmp_path / "counted")
    assert [sinks.append_counted(rows, path, "k", "n") for _ in range(2)] == [2, 0]
    more = rows.unionByName(spark.createDataFrame([("b", 3, "q"), ("b", 3, "p")], rows.schema))
    assert sinks.append_counted(more, path, "k", "n") == 1
    assert sorted(map(str, spark.read.parquet(path).select("k", "n", "v").collect())) == sorted(map(str, [r for r in more.collect() if r["v"] in ("x", "z", "p")]))


def test_provenance_and_names_without_a_resolution(spark):
    rows = case_tables.mentions(spark, "/root/testdata/sf0.001")
    twice = rows.unionByName(rows.where("source_index = 0").withColumn("raw_value", F.concat("raw_value", F.lit("!"))))
    resolved = resolve.resolve(twice)
    columns = ["mention_key", "entity_key", *resolve.PLACE, "raw_value"]
    assert sorted(map(str, resolve.provenance_values(twice).select(columns).collect())) == sorted(map(str, resolve.provenance(resolved).select(columns).collect()))
    names = lambda df: sorted(map(tuple, df.select("entity_type", "normalized_name").distinct().collect()))
    assert names(resolve.entity_names(twice)) == names(resolve.entities(resolved))
