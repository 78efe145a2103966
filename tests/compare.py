"""Row-by-row comparison of a query with its DuckDB oracle, order aside."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False)), key=repr)


def oracle(sf_dir: str, sql: str, **tables) -> pd.DataFrame:
    with duckdb.connect() as db:
        for t in TABLES:
            if t in tables:
                db.register(t, tables[t])
            else:
                db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return db.sql(sql).df()
