"""Rows of a query and of its SQL in one comparable form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    return None if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[c]) for c in names] for r in df.toArrow().to_pylist()), key=repr)


def sql_rows(con, sql):
    table = con.sql(sql).to_arrow_table()
    names = sorted(table.column_names)
    return names, sorted(([plain(r[c]) for c in names] for r in table.to_pylist()), key=repr)
