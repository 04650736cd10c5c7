"""Holds a query's rows against those of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, float):
            v = round(v, 6)
            return str(int(v)) if v == int(v) else str(v)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(value(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


def same(spark_df, duck_rel) -> None:
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x == y
