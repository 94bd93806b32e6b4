"""Run registered queries next to their DuckDB counterparts and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cells = lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA else (
        float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v))
    rows = [tuple(cells(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    """None when equal, else the reason."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} vs {len(duck_df)}"
    a, b = _norm(spark_df), _norm(duck_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(sf: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from locavec.session import local_session

    spark = local_session(8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            dt = time.time() - t
            if name in oracles:
                why = compare(got, con.execute(oracles[name]).df())
                print(f"{'ok  ' if why is None else 'FAIL'} {name} rows={len(got)} {dt:.1f}s {why or ''}", flush=True)
                failed += why is not None
            else:
                print(f"rows {name} rows={len(got)} {dt:.1f}s", flush=True)
        except Exception as exc:  # report and go on
            failed += 1
            print(f"ERR  {name} {time.time() - t:.1f}s {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
