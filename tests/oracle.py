"""Runs a registered query and its SQL twin, and compares schema and rows."""

import glob
import math
import os

import duckdb

SPARK_TO_SQL = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def expected(con, sql):
    cursor = con.execute(sql)
    schema = {column[0]: str(column[1]) for column in cursor.description}
    return schema, _sorted(schema, cursor.fetchall())


def actual(frame):
    schema = {name: SPARK_TO_SQL.get(kind, kind) for name, kind in frame.dtypes}
    return schema, _sorted(schema, [tuple(row) for row in frame.collect()])


def _sorted(schema, rows):
    order = sorted(range(len(schema)), key=list(schema).__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=_key)


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    return value


def _key(row):
    return [(value is not None, str(value)) for value in row]
