"""Registered queries against their SQL, and that the entry module stands without the llm folder."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from casenet.plans.queries import ORACLES, QUERIES

DATA, ROOT = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row, strict=True))]) for row in cursor.fetchall())
    assert sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect()) == want


@pytest.mark.parametrize("missing", ["folder", "library"])
def test_entry_stands_without_the_llm_folder_or_its_libraries(tmp_path, missing):
    left_out = ("llm", "__pycache__") if missing == "folder" else ("__pycache__",)
    shutil.copytree(f"{ROOT}/casenet", tmp_path / "casenet", ignore=shutil.ignore_patterns(*left_out))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if missing == "library":
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'entities' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, check=True, timeout=120)
