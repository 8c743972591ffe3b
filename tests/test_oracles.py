"""Every query of the core with SQL gives the rows of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import duck_rows, plain
from earshot import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    names, want = duck_rows(con, SQL[name])
    assert cols == names
    assert got == want


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"lexical_search", "semantic_search", "evaluated_search"}))
def test_queries_without_sql_run(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    assert df.columns and df.count() >= 0
