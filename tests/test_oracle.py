"""Every registered query against its independent SQL text (DuckDB) at sf0.001.

The driver repeats this at sf0.01; ``python tests/oracle.py`` runs it at any
scale.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from larder.plans.registry import QUERIES
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["category_name", "total_units_sold", "total_revenue"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, con)
    assert r["status"] in ("match", "rows-only"), r
