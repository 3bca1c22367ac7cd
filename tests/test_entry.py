import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def rows(names, table):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in (r[names.index(c)] for c in sorted(names)))) for r in table)


def test_entry(spark):
    assert e.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(n for n in e.oracle_sql() if not n.startswith("op")))
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    got = e.queries()[name](spark, SF)
    want = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_the_rest_imports_without_the_training_operators(tmp_path):
    root = os.path.dirname(e.__file__)
    for item in ("driftline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{item}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/driftline/llm"], check=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'ks_quantity_by_flag' in n and not any(k.startswith('op') or k == 'pipeline' for k in n), n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
