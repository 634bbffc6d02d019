"""The driver contract: every query runs on the smallest tables and equals its oracle."""

import glob
import math
import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    out = db.sql(entry.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["machine_id", "plugin_id", "field_name", "file_path"]


def test_works_without_the_text_subpackage():
    code = "import sys; sys.modules['kelpline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p7_ids' not in q; e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
