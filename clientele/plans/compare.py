"""Order-insensitive result comparison used by the oracle checks."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# Keys checked rows-only: model fits and their consumers.
ROWS_ONLY = {"m02_bgnbd_fit", "m03_gamma_gamma_fit",
             "m04_clv", "t08_top_clv", "m08_forest_scores", "m11_feature_importances",
             "a24_clv_histogram", "m10_forest_metrics"}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted(tuple(norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join("|".join(r) for r in out).encode()).hexdigest()
    return [cols[i] for i in order], out, h


def duckdb_connection(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
