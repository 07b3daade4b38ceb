"""Every registered query gives the rows and the schema of its SQL twin."""

import oracle
import pytest

import __spark_entry__ as entry
from reviewloom import workload

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert workload.queries().keys() == workload.oracle_sql().keys()
    assert workload.queries().items() <= entry.queries().items()


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query(spark, con, name):
    schema, rows = oracle.actual(workload.queries()[name](spark, SF_DIR))
    want_schema, want = oracle.expected(con, workload.oracle_sql()[name])
    assert dict(sorted(schema.items())) == dict(sorted(want_schema.items()))
    assert rows == want
    assert rows


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["AppID", "Name", "Reviews"]
    assert frame.count() == 5
