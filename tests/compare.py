"""Compare a Spark result with the oracle's, value by value and regardless of order."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    oracle_columns = [d[0] for d in found.description]
    oracle_types = {d[0]: str(d[1]) for d in found.description}
    oracle = rows_of(oracle_columns, found.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(spark_df.columns) != sorted(oracle_columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(oracle_columns)}")
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    for field in spark_df.schema:
        kind = names.get(field.dataType.simpleString(), field.dataType.simpleString())
        if field.name in oracle_types and oracle_types[field.name] != kind:
            problems.append(f"type of {field.name}: {kind} != {oracle_types[field.name]}")
    if len(ours) != len(oracle):
        problems.append(f"rows {len(ours)} != {len(oracle)}")
    if ours != oracle:
        only_ours, only_oracle = sorted(set(ours) - set(oracle)), sorted(set(oracle) - set(ours))
        problems.append(f"{len(only_ours)} rows only here, e.g. {only_ours[:2]}; oracle only {only_oracle[:2]}")
    return problems
