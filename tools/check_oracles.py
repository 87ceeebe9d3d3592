"""Run registered queries against their reference SQL: python tools/check_oracles.py [folder] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from lotweave.queries import ORACLES, QUERIES  # noqa: E402
from lotweave.queries.views import TABLES  # noqa: E402


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder, name):
    t0 = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if name not in ORACLES:
        return "rows-only", f"{len(got[1])} rows", took
    cur = con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", f"{got[0]} / {want[0]}", took
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if names.get(t, t) != types[c]]
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return "DIFF", f"rows {len(got[1])}/{len(want[1])} spark-only {len(a)} {sorted(a)[:2]} sql-only {len(b)} {sorted(b)[:2]}", took
    return ("TYPES " + ",".join(odd) if odd else "ok"), f"{len(got[1])} rows", took


def main():
    from bench import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(8), connect(folder)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, note, took = check(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            status, note, took = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", 0.0
        fine = status in ("ok", "rows-only")
        bad += not fine
        if not fine or "-v" in sys.argv or not wanted:
            print(f"{name:44s} {status:10s} {took:6.2f}s {note if not fine or status == 'rows-only' else note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
