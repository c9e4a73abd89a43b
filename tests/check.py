"""Run registered queries against DuckDB on the same tables: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None when both sides agree, otherwise what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(df.columns)}\n  spark {g}\n  duck  {w}"
        if [type(x) for x in g] != [type(x) for x in w]:
            return f"types differ: {g} / {w}"
    return None if got else "EMPTY"


def main() -> int:
    import __spark_entry__ as contract
    from tallymart.session import local_session

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    wanted = args[1:] or list(contract.queries())
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in wanted:
        fn, sql = contract.queries()[name], contract.oracle_sql().get(name)
        started = time.time()
        try:
            if sql is None:
                n = fn(spark, sf_dir).count()
                verdict = f"rows only: {n}"
            else:
                diff = compare(spark, con, sf_dir, fn, sql)
                verdict = "ok" if diff is None else f"DIFF {diff}"
                bad += diff is not None
        except Exception as exc:
            bad += 1
            verdict = "ERROR " + "".join(traceback.format_exception_only(exc))[:1500]
        print(f"{name:32s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
