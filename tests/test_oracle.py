"""Every registered query with an oracle matches DuckDB (sf0.001 by default)."""
import pytest

import __spark_entry__ as E
from parity import compare, duck_con

from conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, name, E.queries()[name], ORACLES[name], SF_SMALL, con)
    spark.catalog.clearCache()
    assert info["ok"], info


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"service", "is_franchise", "n_stores", "n_closed", "closure_rate"}
    assert df.count() > 0
