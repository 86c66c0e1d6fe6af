"""Small indexes from literals, and the comparison of a query with its SQL."""

from __future__ import annotations

import pandas as pd

from graphloom.index import SCHEMAS, Index


def make(spark, symbols=(), refs=(), imports=(), edges=(), files=None, vectors=None) -> Index:
    """symbols: (id, name, kind, file, line[, scope]); refs: (name, file, line, caller_id, confidence[, target_id])."""
    syms = [(s[0], s[1], s[2], s[3], s[4], 0, s[4] + 3, s[5] if len(s) > 5 else None, f"{s[2]} {s[1]}", "rust", None) for s in symbols]
    calls = [(r[0], r[1], r[2], 0, f"{r[0]}()", r[3], r[4], r[5] if len(r) > 5 else None) for r in refs]
    paths = files if files is not None else sorted({s[3] for s in symbols} | {i[0] for i in imports})
    return Index(
        spark.createDataFrame([(p, "rust", "h" + p, 0, 10, 1) for p in paths], SCHEMAS["files"]),
        spark.createDataFrame(syms, SCHEMAS["symbols"]),
        spark.createDataFrame(calls, SCHEMAS["refs"]),
        spark.createDataFrame(list(imports), SCHEMAS["imports"]),
        spark.createDataFrame(list(edges), SCHEMAS["type_edges"]),
        spark.createDataFrame(list(vectors or []), SCHEMAS["embeddings"]),
    )


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c
