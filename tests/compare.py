"""Run registered queries in Spark and their SQL in DuckDB, and compare all values.

    python -m tests.compare sf_dir [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("n", round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(cell(i) for i in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, cell(i)) for k, i in v.items())))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return len(got), f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} rows differ, first {bad[0]}"
    return len(got), ""


def main(argv):
    from lineweave.plans import ORACLES, QUERIES
    from lineweave.session import local_session

    sf_dir, prefixes = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            n, verdict = compare(spark, con, fn, ORACLES.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            n, verdict = -1, f"{type(exc).__name__}: {str(exc)[-1200:]}"
        state = "rows only" if verdict is None else ("ok" if verdict == "" else "FAIL " + verdict)
        failed += state.startswith("FAIL")
        print(f"{name:32s} {n:8d} rows {time.time() - t0:6.2f}s  {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
