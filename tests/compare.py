"""Compare a Spark result with a DuckDB result, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, float):
        return f"float {v + 0.0:.12g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, int):
        return f"int {v}"
    return str(v)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    """Empty text when both agree on column names and on every row."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = normal_rows(want_cols, cur.fetchall())
    got_cols = spark_df.columns
    got = normal_rows(got_cols, [tuple(r) for r in spark_df.collect()])
    if sorted(want_cols) != sorted(got_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if got == want:
        return ""
    extra = sorted(set(got) - set(want))[:3]
    missing = sorted(set(want) - set(got))[:3]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"
