"""Run a query on Spark and its SQL on DuckDB and describe the first differences."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(value)


def differences(spark_df, con, sql: str, limit: int = 4) -> list[str]:
    names = sorted(spark_df.columns)
    result = con.sql(sql)
    found = []
    if sorted(result.columns) != names:
        return [f"columns: spark only {set(names) - set(result.columns)}, sql only {set(result.columns) - set(names)}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(result.columns, map(str, result.types)))
    for field in spark_df.schema.fields:
        expected = kinds.get(field.dataType.simpleString())
        if expected and types[field.name] != expected:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} and {types[field.name]}")
    order = [result.columns.index(n) for n in names]
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    ours = Counter(tuple(_cell(v) for v in row) for row in spark_df.select(*[f"`{n}`" for n in names]).collect())
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        found.append(f"rows: spark {sum(ours.values())}, sql {sum(theirs.values())}; "
                     f"only spark {sum(a.values())}, only sql {sum(b.values())}")
        found.append(f"names {names}")
        found += [f"spark {sorted(a, key=str)[:limit]}", f"sql   {sorted(b, key=str)[:limit]}"]
    return found
