"""Run registered queries against their DuckDB oracles: `python -m tests.check_queries [substring ...]`."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


def compare(df, con, sql):
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dcols, drows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} != {dcols}", len(srows)
    if len(srows) != len(drows):
        a, b = set(srows), set(drows)
        return (f"rows {len(srows)} != {len(drows)}; only spark {sorted(a - b, key=repr)[:2]} "
                f"only duck {sorted(b - a, key=repr)[:2]}"), len(srows)
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        return f"{len(bad)} of {len(srows)} differ, e.g.\n   spark {str(bad[0][0])[:600]}\n   duck  {str(bad[0][1])[:600]}", len(srows)
    return None, len(srows)


def main(argv):
    import __spark_entry__ as entry
    from pressgrain.session import build_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if os.environ.get("CHECK_NO_SQL"):
                df.write.format("noop").mode("overwrite").save()
                n, problem, kind = 1, None, "noop"
            elif name in oracles:
                problem, n = compare(df, con, oracles[name])
                kind = "sql"
            else:
                n, problem, kind = len(df.collect()), None, "rows"
        except Exception as e:  # report and go on with the next query
            problem, n, kind = f"{type(e).__name__}: {str(e)[:900]}", -1, "?"
        bad += problem is not None
        note = "  EMPTY" if n == 0 else ""
        if problem or note or "-v" in sys.argv or os.environ.get("CHECK_ALL"):
            print(f"{'BAD ' if problem else 'ok  '} {name:34s} {kind:4s} rows={n} {time.time() - start:5.1f}s{note} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if not a.startswith("-")])
