"""Every registered query of the library against its SQL on the smallest tables; the others must give rows."""

import compare
import pytest
from compare import SMALL

from plotline.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert compare.difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0
    spark.catalog.clearCache()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
