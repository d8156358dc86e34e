"""Holds registered queries against their DuckDB SQL."""

import os

import duckdb


def normal(rows):
    def text(v):
        if v is None:
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


def connected(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def assert_same(df, duck, sql):
    columns = sorted(df.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = normal(tuple(r[i] for i in at) for r in result.fetchall())
    assert normal(tuple(r[c] for c in columns) for r in df.collect()) == want
