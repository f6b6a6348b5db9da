"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(value + 0.0)
    return "null" if value is None else repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


_FAMILIES = {
    "int": "int32", "bigint": "int64", "double": "double", "string": "text", "boolean": "bool",
    "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool",
}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: names, types, row count, rows. Empty if nothing does."""
    cursor = con.execute(sql)
    sql_types = {d[0]: _FAMILIES.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected_rows = cursor.fetchall()
    names, types = [c for c, _ in df.dtypes], {c: _FAMILIES.get(t, t) for c, t in df.dtypes}
    problems = []
    if sorted(names) != sorted(sql_types):
        return [f"columns {sorted(set(names) ^ set(sql_types))}"]
    for c in names:
        if types[c] != sql_types[c]:
            problems.append(f"type of {c}: {types[c]} / {sql_types[c]}")
    got = _rows(names, [tuple(r) for r in df.collect()])
    expected = _rows(list(sql_types), expected_rows)
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} / {len(expected)}")
    elif got != expected:
        bad = [(g, e) for g, e in zip(got, expected) if g != e]
        order = sorted(names)
        columns = sorted({order[i] for g, e in bad for i in range(len(order)) if g[i] != e[i]})
        problems.append(f"{len(bad)} rows differ in {columns}, e.g. {bad[0]}"[:600])
    return problems
