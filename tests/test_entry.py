"""The driver contract: registered queries run, and those with SQL give the rows that DuckDB gives."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
QUICK = ["graph_degrees", "graph_stats", "sources_random_hash", "ppr_forward_push", "reverse_push", "walk_index", "hub_index", "dht_global_iteration", "ppr_one_hop_walks"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", QUICK)
def test_rows_equal_those_of_sql(spark, name):
    import duckdb
    import pandas as pd

    from wanderlane.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    a, b = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=0, atol=0)
