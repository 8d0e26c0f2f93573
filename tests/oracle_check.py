"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def _type(v):
    return {bool: "b", int: "i", float: "f", str: "s"}.get(type(v), type(v).__name__)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(r[n] for n in names) for r in df.collect()]


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = cur.fetchall()
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in rows]


def differences(left, right):
    """Text of the first difference between two (names, rows), or None."""
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"columns {ln} / {rn}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} / {len(rr)}"
    a = sorted(tuple(map(_cell, r)) for r in lr)
    b = sorted(tuple(map(_cell, r)) for r in rr)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} / {y}"
    for i, name in enumerate(ln):
        lt = {_type(r[i]) for r in lr if r[i] is not None}
        rt = {_type(r[i]) for r in rr if r[i] is not None}
        if lt != rt:
            return f"type of {name}: {lt} / {rt}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from kohorta.session import local_session

    spark = local_session("8")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - t
            note = differences(got, sql_rows(con, oracle[name])) if name in oracle else "no sql"
        except Exception as e:  # report and go on with the next query
            took, note = time.time() - t, f"ERROR {str(e)[:600]}"
            got = (None, [])
        bad += note not in (None, "no sql")
        print(f"{name:28s} {took:6.2f}s rows={len(got[1]):7d} {note or 'ok'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
