"""The pipeline's stages against plain statements of what each must keep."""

from __future__ import annotations

import re

import corpus_pipeline
from test_llm_operators import LABELS, components, documents, messy_rows, prose, repeated_50

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_they_must(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        docs = stage(spark, docs, DATA)
        if name != "packing":
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    after = {r["doc_id"] for r in rows["exact"]}
    labelled_good = good & {r["doc_id"] for r in rows["quality"]}
    assert len(labelled_good & after) >= 0.97 * len(labelled_good)
    first = {}
    for r in sorted(rows["exact"], key=lambda r: r["doc_id"]):
        first.setdefault(SPACE.sub(" ", r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in rows["near"]} == set(first.values())
    linked = components([(r["doc_id"], r["text"]) for r in rows["near"]], 5, 80)
    assert {r["doc_id"] for r in rows["passages"]} == {i for i, (_, c) in linked.items() if i == c}
    assert not repeated_50([(r["doc_id"], r["text"]) for r in rows["packing"]])
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in rows["packing"])


def test_run_gives_the_last_stage(spark):
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.columns == ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch_id", "row_in_batch", "padding"]
    assert packed.count() == packed.select("doc_id").distinct().count() > 0


def test_stages_on_messy_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, clashing columns, and no rows at all."""
    rows = [(i, t) for i, t in messy_rows() if i not in (6, 7)]
    rows += [(20, "ok ok"), (20, prose(5, 90)), (20, prose(5, 90)), (None, None), (None, prose(6, 90)), (None, prose(7, 90)), (21, prose(6, 90))]
    for docs in (documents(spark, rows), documents(spark, rows).limit(0)):
        folder = str(tmp_path / f"n{docs.count()}")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1), (8, None, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
        now, held = docs, [rows if docs.count() else []]
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            if name != "packing":
                assert now.schema == docs.schema
            now = spark.createDataFrame(now.collect(), now.schema)
            held.append([(r["doc_id"], r["text"]) for r in now.collect()] if name != "packing" else now.collect())
        assert len(set(held[2])) == len(held[2]) and {SPACE.sub(" ", t or "") for _, t in held[1]} == {SPACE.sub(" ", t or "") for _, t in held[2]}
        assert {t for i, t in held[2] if i is None} <= {t for i, t in held[3] if i is None}
        assert len(held[5]) == len(held[4])
        assert corpus_pipeline.run(spark, folder).count() == len(held[5])
