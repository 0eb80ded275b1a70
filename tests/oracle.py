"""Run registered queries next to their SQL and compare the values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (0, "")
        return (2, repr(float(v)) if abs(v) < 2**53 else repr(int(v)))
    if isinstance(v, dt.datetime):
        return (3, v.isoformat())
    return (4, str(v))


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds(types):
    short = {"bigint": "int", "integer": "int", "int": "int", "smallint": "int", "hugeint": "huge", "varchar": "str", "string": "str",
             "timestamp_ntz": "ts", "timestamp": "ts"}
    return [short.get(str(t).lower(), str(t).lower()) for t in types]


def compare(spark, con, name, build, sql, sf_dir):
    start = time.time()
    df = build(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return ("rows", len(rows), took, "")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, kinds([d[1] for d in cur.description])))
    mine = dict(zip(df.columns, kinds([f.dataType.simpleString() for f in df.schema.fields])))
    a, b = table(df.columns, rows), table(names, cur.fetchall())
    if a[0] != b[0]:
        return ("columns", len(rows), took, f"{a[0]} != {b[0]}")
    if len(a[1]) != len(b[1]):
        return ("count", len(rows), took, f"{len(a[1])} != {len(b[1])}")
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return ("values", len(rows), took, f"{len(bad)} differ, first {bad[0][0]} != {bad[0][1]}")
    if mine != types:
        return ("types", len(rows), took, str({k: (mine[k], types[k]) for k in mine if mine[k] != types[k]}))
    return ("ok", len(rows), took, "")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rowloom import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls = entry.oracle_sql()
    for name, build in sorted(entry.queries().items()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, rows, took, note = compare(spark, con, name, build, sqls.get(name), sf)
        except Exception as err:  # noqa: BLE001
            state, rows, took, note = "ERROR", 0, 0.0, f"{type(err).__name__}: {str(err)[:400]}"
        print(f"{state:8} {name:36} {rows:7} rows {took:6.2f}s {note}", flush=True)
