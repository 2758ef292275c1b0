"""Compare registered queries with their SQL on the same Parquet files."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty text when equal, else the first difference."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"got {g}\nwant {w}"
    return "" if got else "both empty"


def main() -> None:
    from earlog.plans.registry import load
    from earlog.session import build_session
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    pick = sys.argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, (fn, sql) in load().items():
        if pick and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            msg = compare(df, sql, con) if sql else f"rows only: {df.count()}"
            fail = bool(sql and msg)
        except Exception as e:                                    # noqa: BLE001
            msg, fail = f"{type(e).__name__}: {str(e)[:1500]}", True
        bad += fail
        print(f"{'FAIL' if fail else 'ok  '} {name:28s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
