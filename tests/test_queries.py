"""Every query of the engine that has SQL, against DuckDB."""

from __future__ import annotations

import oracle
import pytest

from orograph import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    got, wanted = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert oracle.rows(got) == oracle.rows(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
