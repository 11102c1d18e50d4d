"""Every registered query against its DuckDB oracle on sf0.001."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from scripts.check_oracle import digest, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL oracle")
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    s = digest(sdf.columns, srows)
    d = digest(dcols, res.fetchall())
    assert s[0] == d[0]
    assert s[1] == d[1]
    assert s[3] == d[3]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["path", "size", "md5", "keeper_path", "action"]
