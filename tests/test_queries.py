"""Every registered query runs; every SQL twin agrees with it."""

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry_points
from sluice.plans import COVERS, QUERIES as OWN
from tests.oracle import connect, spark_rows, sql_rows

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert not [f.name for f in df.schema if isinstance(f.dataType, (T.VariantType, T.MapType))]
    columns, rows = spark_rows(df)
    assert rows
    if name in ORACLES:
        assert (columns, rows) == sql_rows(con, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(COVERS) == set(OWN) <= set(QUERIES)


def test_entry_matches_the_known_totals(spark):
    # counts and sums of the smallest scale, fixed by its generator
    known = {
        "events-click": (210, 9707),
        "events-error": (201, 10442),
        "events-purchase": (202, 9664),
        "events-signup": (199, 9738),
        "events-view": (188, 9325),
    }
    assert {r["topic"]: (r["messages"], r["total"]) for r in entry_points.entry(spark).collect()} == known
