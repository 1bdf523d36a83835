import pytest

from colloquy import queries as engine
from tests.conftest import DATA
from tests.oracle import connect, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", engine.QUERIES)
def test_query_equals_its_sql(spark, con, name):
    assert same(engine.QUERIES[name](spark, SF), con, engine.ORACLES[name])


def test_times_do_not_depend_on_the_session_zone(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(engine.QUERIES["usage_by_day"](spark, SF), con, engine.ORACLES["usage_by_day"])
        same(engine.QUERIES["inspect_summary"](spark, SF), con, engine.ORACLES["inspect_summary"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert set(engine.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
