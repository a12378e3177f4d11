"""Compares a query's rows with its SQL's, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, sql, sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = db.execute(sql)
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
