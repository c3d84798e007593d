import pytest

from driftrank import oracle, queries
from tests.compare import duck, same
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, con, name):
    same(queries.Q[name](spark, SF), con, oracle.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(oracle.ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_metrics(spark):
    row = queries.Q["metrics_mean"](spark, SF).first()
    assert row.batches == 2 and row.ppr_latency > 0 and row.ppr_throughput > 0
