"""Every query with SQL gives what its SQL gives."""

import pytest

from lattica.plans import queries as q
from tests.helpers import SF, oracle, same


@pytest.fixture(scope="module")
def con():
    return oracle()


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, con, name):
    same(q.QUERIES[name](spark, SF).toPandas(), con.execute(q.SQL[name]).df())


def test_known_pair_numbers(spark):
    got = q.pair_energy_lj(spark, SF).first()
    assert got["e"] == pytest.approx(-778.5835)
    counted = q.pairs_within_cutoff(spark, SF).toPandas()
    assert counted["n"].sum() == 130085
    assert counted["r2"].sum() == pytest.approx(45075.4314, abs=1e-3)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
