"""Run a registered query and its SQL side by side and compare columns, row counts and values."""

import datetime
import decimal
import os

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in NAMES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, float):
        return f"{value:.9g}"
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)
    return [columns[i] for i in order], lines


def spark_result(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def duck_result(con, sql):
    cursor = con.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def difference(ours, theirs):
    """None when equal, else a short description."""
    (columns, rows), (other_columns, other_rows) = ours, theirs
    if columns != other_columns:
        return f"columns {columns} != {other_columns}"
    if len(rows) != len(other_rows):
        return f"rows {len(rows)} != {len(other_rows)}; only spark {list(set(rows) - set(other_rows))[:3]}; only sql {list(set(other_rows) - set(rows))[:3]}"
    if rows != other_rows:
        pair = next((a, b) for a, b in zip(rows, other_rows) if a != b)
        bad = sum(a != b for a, b in zip(rows, other_rows))
        return f"{bad} rows differ, first spark {pair[0]} sql {pair[1]}"
    return None
