"""Compare a registered query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


def compare(spark, query, sql, sf):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got, want = query(spark, sf).toPandas(), db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
