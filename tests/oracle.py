"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value + 0.0)
    if value is None:
        return "NULL"
    return str(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "FLOAT": "float",
}


def compare(spark, con, name, fn, sql, sf_dir):
    """The differences between a query and its SQL, as text; empty when they agree."""
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return [] if got_rows else [f"{name}: no rows"]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    want_rows = result.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"]
    types = dict(df.dtypes)
    for column in columns:
        if types[column] != kinds[column]:
            problems.append(f"{name}: {column} is {types[column]} against {kinds[column]}")
    got, want = _bag(df.columns, got_rows), _bag(columns, want_rows)
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"{name}: {len(got_rows)} rows against {len(want_rows)}; only here {extra}; only there {missing}")
    if not want_rows:
        problems.append(f"{name}: the SQL gives no rows, so it tests nothing")
    return problems
