"""Compare a query with its DuckDB statement on one data folder."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        kind = pdf[c].dtype.kind
        if kind == "M":
            pdf[c] = pdf[c].astype("datetime64[us]")
        elif kind == "O" and len(pdf) and type(pdf[c].dropna().iloc[0] if pdf[c].notna().any() else "").__name__ == "date":
            pdf[c] = pd.to_datetime(pdf[c]).astype("datetime64[us]")
    keys = pdf.apply(lambda s: s.map(lambda v: "" if v is None or v != v else (f"{v:.4f}" if isinstance(v, float) else str(v))))
    order = keys.sort_values(list(keys.columns)).index if len(keys) else keys.index
    return pdf.loc[order].reset_index(drop=True)


def _null(v) -> bool:
    return v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    """The differences, empty when the two agree exactly."""
    problems = []
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return [f"columns {sorted(spark_pdf.columns)} != {sorted(oracle_pdf.columns)}"]
    if len(spark_pdf) != len(oracle_pdf):
        return [f"rows {len(spark_pdf)} != {len(oracle_pdf)}"]
    a, b = _ordered(spark_pdf), _ordered(oracle_pdf)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if ka != kb and not {ka, kb} <= {"i", "u"}:
            problems.append(f"{c}: type {a[c].dtype} != {b[c].dtype}")
        x, y = a[c], b[c]
        if {ka, kb} <= {"i", "u", "f", "b"}:
            x, y = x.to_numpy(dtype=float), y.to_numpy(dtype=float)
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
            if bad.any():
                i = int(np.argmax(bad))
                close = np.allclose(x, y, rtol=1e-9, atol=2e-6, equal_nan=True)
                problems.append(f"{c}: {bad.sum()} values differ ({'close' if close else 'FAR'}), first {x[i]!r} != {y[i]!r}")
        else:
            xs, ys = x.where(x.notna(), None).astype(object), y.where(y.notna(), None).astype(object)
            bad = np.array([not (p == q or (_null(p) and _null(q))) for p, q in zip(xs, ys)])
            if bad.any():
                i = int(np.argmax(bad))
                problems.append(f"{c}: {bad.sum()} values differ, first {xs[i]!r} != {ys[i]!r}")
    return problems
