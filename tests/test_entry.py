import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the small tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(records, names):
    order = [names.index(n) for n in sorted(names)]
    return sorted(([r[i] for i in order] for r in records), key=repr)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("q")])
def test_query_equals_sql(spark, sql, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    want = sql.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['siltlog.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries())[0], len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == ["q01_get_latest", str(sum(n.startswith("q") for n in __spark_entry__.queries()))]
