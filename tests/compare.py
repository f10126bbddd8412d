"""Rows of a Spark result against those of its DuckDB SQL."""

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(float(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(str(plain(v)) for v in r) for r in df[cols].itertuples(index=False))


def duck(sql, data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con.execute(sql).df()
