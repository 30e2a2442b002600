"""Each query of the catalogue against its SQL on DuckDB."""

import duckdb
import pytest

from tideline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted([str(round(x, 6)) if isinstance(x, float) else str(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got) == plain(want.project(quoted).fetchall())


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_graphs_of_chains_do_not_meet_in_one_task(spark):
    plan = catalog.queries()["braid_graphs"](spark, SF)._jdf.queryExecution().toString()
    assert "InPandas" not in plan
