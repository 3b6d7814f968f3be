"""Every registered query against its SQL, and independence of the partitioning."""

import pytest

from tests.compare import database, spark_rows, sql_rows
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert got == sql_rows(db, ORACLES[name])
    else:
        assert got[1]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["correlation", "tail", "cap", "top_ips", "spikes", "report_rows"])
def test_result_does_not_depend_on_partitions(spark, db, name, monkeypatch):
    from workload import adapter

    plain = adapter.table
    monkeypatch.setattr(adapter, "table", lambda s, d, n: plain(s, d, n).repartition(13))
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(db, ORACLES[name])
