"""Every query of the catalogue against its SQL, and the ones without SQL for running at all."""

import pytest

from roamgrid import catalogue, oracles
from tests.compare import DATA, same_rows

QUERIES, SQL = catalogue.queries(), oracles.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name], "sf0.001")


def test_vehicles_on_the_roads(spark):
    """The only query without SQL; its parts are tested on small cases."""
    assert set(QUERIES) - set(SQL) == {"snap_to_road"}
    got = QUERIES["snap_to_road"](spark, f"{DATA}/sf0.001").collect()
    points = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").selectExpr("user_id div 3 AS taxi").distinct().count()
    assert len(got) == points and all(r.places >= 2 for r in got)
