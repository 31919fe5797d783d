"""Compare the rows of a Spark query with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(df):
    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def same(spark_df, con, sql):
    a, b = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert a.shape == b.shape
    assert a.equals(b)
