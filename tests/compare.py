"""Row-by-row comparison of a Spark result with DuckDB's."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v) -> tuple[int, str]:
    """Nulls, numbers and other values apart: null isn't the empty text, and integers keep all their digits."""
    if isinstance(v, (list, tuple, dict, np.ndarray)):
        return 2, str(list(v) if isinstance(v, np.ndarray) else v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return 0, ""
    if isinstance(v, (bool, np.bool_)):
        return 2, str(bool(v))
    if isinstance(v, (int, np.integer)):
        return 1, f"{int(v)}.000000"
    if isinstance(v, (float, np.floating)):
        return 1, f"{round(float(v), 6) + 0.0:.6f}"
    return 2, str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    columns = [df[c].astype(object) for c in sorted(df.columns)]
    return sorted(tuple(map(cell, row)) for row in zip(*columns))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
