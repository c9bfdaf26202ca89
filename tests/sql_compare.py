"""Running a query and its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder, tables=TABLES):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(x):
    if x is None or (not isinstance(x, (list, tuple, dict)) and pd.isna(x)):
        return ""
    text = str(round(x, 6)) if isinstance(x, float) else str(x)
    return text.removesuffix(".0")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))
