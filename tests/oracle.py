"""Compare a query with its SQL on DuckDB, as sets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return str(x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == _rows(out.fetchall(), columns)
