"""The corpus queries' SQL on the smallest tables."""

import duckdb
import pytest

from headway.llm import queries
from tests.conftest import SF

TABLES = ("documents", "pages", "labels", "conversations", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    names = sorted(found.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]}) q").fetchall()
    cell = lambda x: None if x is None else f"{x:.9f}" if isinstance(x, float) else str(x)
    text = lambda rows: sorted(str([cell(x) for x in r]) for r in rows)
    assert text(found.select(*names).collect()) == text(want)
