"""Every registered query against its SQL on the smallest supplied tables."""

import os

import duckdb
import pytest

from floeberg import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SLOW = {"infomap_communities", "sub_modules"}  # covered by test_communities.py

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - SLOW))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name not in plans.oracle_sql():
        return
    want = duck.sql(plans.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist())


def test_entry_can_be_asked_again_and_again(spark):
    import __spark_entry__ as entry

    for _ in range(2):
        assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).limit(1).count() == 1
