"""Every registered query equals its DuckDB SQL at sf0.01 (exact values)."""

import pytest

from curbscope.plans.oracle_queries import SQL
from curbscope.plans.registry import QUERIES
from tests.conftest import SF01
from tests.oracle_check import compare, duck_connect, rows_of_duck, rows_of_spark


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF01)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sc, sr = rows_of_spark(QUERIES[name](spark, SF01))
    dc, dr = rows_of_duck(duck, SQL[name])
    res = compare(sc, sr, dc, dr)
    assert res["ok"], res


def test_tier_hotspots_rows(spark):
    out = QUERIES["tier_hotspots"](spark, SF01)
    feats = QUERIES["hex_bin"](spark, SF01)
    assert out.count() == feats.count()
    assert {r.tier for r in out.select("tier").distinct().collect()} <= {
        "Critical", "High", "Medium", "Low"}
