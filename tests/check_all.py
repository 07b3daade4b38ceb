"""Compare all (or the named) queries with their SQL: python tests/check_all.py [sf] [names]"""

import os
import sys
import time

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [here, os.path.dirname(here)]

import oracle  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from reviewloom.session import build_session  # noqa: E402


def main(sf="sf0.01", *names):
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name, run in entry.queries().items():
        if name not in (names or entry.oracle_sql()):
            continue
        began = time.time()
        try:
            got_schema, got = oracle.actual(run(spark, sf_dir))
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - began
        began = time.time()
        try:
            want_schema, want = oracle.expected(con, entry.oracle_sql()[name])
        except Exception as error:
            bad += 1
            print(f"SQL ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        sql_took = time.time() - began
        same_schema = dict(sorted(got_schema.items())) == dict(sorted(want_schema.items()))
        ok = same_schema and got == want
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name} rows={len(got)}/{len(want)} "
              f"{took:.1f}s sql={sql_took:.1f}s", flush=True)
        if not same_schema:
            print("   schema", got_schema, want_schema)
        elif got != want:
            print("   got ", [row for row in got if row not in want][:4])
            print("   want", [row for row in want if row not in got][:4])
    print(f"{bad} not equal")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
