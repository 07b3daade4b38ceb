"""Every query with an SQL twin gives its rows and schema, and the entry registers all."""

import oracle
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reviewloom.llm import queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = oracle.connect(SF_DIR)
    schema, rows = oracle.actual(queries.QUERIES[name](spark, SF_DIR))
    want_schema, want = oracle.expected(con, queries.SQL[name])
    assert dict(sorted(schema.items())) == dict(sorted(want_schema.items()))
    assert rows == want


def test_entry_has_all():
    for n in range(1, 14):
        assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert queries.SQL.items() <= entry.oracle_sql().items()
