"""The registered queries: names, schemas, and every SQL on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__
from headway.jobs import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.oracle_sql())


def shown(rows):
    """Rows as sorted texts; numbers that are not whole to six places."""
    cell = lambda x: None if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(str([cell(x) for x in r]) for r in rows)


def compared(spark, name):
    """The rows of a query and those of its SQL, or what went wrong."""
    try:
        found = registry.queries()[name](spark, SF)
        names = sorted(found.columns)
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({registry.oracle_sql()[name]}) q").fetchall()
        return shown(found.select(*names).collect()), shown(want)
    except Exception as e:  # noqa: BLE001  shown by the test of its name
        return "failed", str(e)


@pytest.fixture(scope="module")
def results(spark):
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(NAMES, pool.map(lambda name: compared(spark, name), NAMES), strict=True))


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "totalNotices" in found.columns


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(results, name):
    found, want = results[name]
    assert found == want
