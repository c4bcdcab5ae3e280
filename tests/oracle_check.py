"""Compare named queries with their SQL on the shared tables: ``oracle_check.py SF_DIR [name …]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return repr(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark, con, sf: str, name: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine = query(spark, sf).toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tonegrid.session import build_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                out = compare(spark, con, sf, name, query, sqls[name]) or "ok"
            else:
                out = f"rows only\n{query(spark, sf).toPandas().to_string()}"
        except Exception as e:  # report and go on with the next query
            out = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:30s} {time.time() - start:7.1f}s  {out}", flush=True)
