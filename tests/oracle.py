"""Rows of a query and of its SQL, made alike for comparison."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}" if math.isfinite(value) else str(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{value:.6f}"
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))
