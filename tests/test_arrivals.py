"""Streams whose rows are written while the query is at work: a whole table is no single task's."""

import os

import oracle
import pytest

from reviewloom import workload
from reviewloom.workload import streams

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, table, key, turns", [
    ("stream_live_over", "lineitem", "l_linenumber", 3),
    ("stream_purge_upto", "events", "event_id", 2),
    ("stream_purge_one", "events", "event_id", 2),
])
def test_arriving_rows_are_written_by_several_tasks(spark, tmp_path, monkeypatch, query, table, key, turns):
    given = tmp_path / "given"
    given.mkdir()
    for name in ("part", "lineitem", "events"):
        if name != table:
            os.symlink(f"{DATA}/{name}.parquet", given / f"{name}.parquet")
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    rows.repartition(4, key).write.parquet(str(given / f"{table}.parquet"))
    files = len(list((given / f"{table}.parquet").glob("*.parquet")))
    assert files > 1
    monkeypatch.setattr(streams, "shared_dir", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a task for each file
    try:
        _, got = oracle.actual(workload.queries()[query](spark, str(given)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    _, want = oracle.expected(oracle.connect(DATA), workload.oracle_sql()[query])
    assert got == want
    folder, = tmp_path.glob("*/arriving")
    assert len(list(folder.rglob("*.parquet"))) > turns
