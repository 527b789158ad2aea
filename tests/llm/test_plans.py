import glob
import os

import duckdb
import pytest

from kelpie.llm import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="no test data")


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_invariants(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = connection.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    df = plans.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cursor.fetchall())
