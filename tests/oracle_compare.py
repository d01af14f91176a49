"""Run a registered Spark query and its DuckDB oracle side by side.

Comparison as the project's correctness gate does it: row count, column
names (sorted), and an order-insensitive multiset of rows with columns
sorted by name. Floats are rounded to 6 significant digits.
"""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v if isinstance(v, str) else str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark_df, con, sql) -> dict:
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    out = {"spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "spark_cols": sc, "oracle_cols": dc}
    out["values_match"] = Counter(map(repr, sr)) == Counter(map(repr, dr))
    if not out["values_match"]:
        a, b = Counter(map(repr, sr)), Counter(map(repr, dr))
        out["only_spark"] = list((a - b).elements())[:5]
        out["only_oracle"] = list((b - a).elements())[:5]
    out["ok"] = out["columns_match"] and out["values_match"] and len(sr) == len(dr)
    return out
