"""Every query of the catalogue against its SQL over the smallest tables."""

import pytest

from lagwright.plans import alignment, catalogue, placing, registry, waveforms  # noqa: F401

from .oracle import connect, rows_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
