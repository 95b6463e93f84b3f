"""Side-by-side comparison of a registered query and its DuckDB twin.

``python -m tests.oracle SF_DIR [NAME_PREFIX ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(float(f"{value:.9g}")) if value != int(value) or abs(value) > 1e15 else str(int(value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return _norm(float(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("\0" if r[i] is None else str(_norm(r[i])) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    frame = fn(spark, sf_dir)
    got = frame.collect()
    took = time.time() - started
    if sql is None:
        return True, f"rows-only {len(got)}", took
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(frame.columns) != sorted(want_names):
        return False, f"columns {sorted(frame.columns)} != {sorted(want_names)}", took
    a, b = rows_of(frame.columns, got), rows_of(want_names, want)
    if a == b:
        return True, f"{len(a)} rows", took
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return False, f"{len(a)} vs {len(b)} rows; spark only {only_a!r:.700} ; sql only {only_b!r:.700}", took


def main():
    from lakefold.session import build_session
    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", 8)
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001 - report and go on
            ok, note, took = False, f"{type(err).__name__}: {str(err)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
