"""Run a registered Spark job and its DuckDB oracle side by side and compare.

Comparison mirrors the driver's: same column names, same row count, and the
same multiset of rows (order-insensitive) with values normalised to text.
Usable from pytest and as a script:

    python tests/oracle_harness.py [sf_dir] [job ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, Decimal):
        return format(v.normalize(), "f") if v == v.to_integral() else format(v, "f").rstrip("0")
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = df.columns
    return cols, [tuple(norm(x) for x in r) for r in df.collect()]


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, [tuple(norm(x) for x in r) for r in cur.fetchall()]


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    import __spark_entry__ as E

    con = con or duck(sf_dir)
    df = E.queries()[name](spark, sf_dir)
    scols, srows = rows_of_spark(df)
    out = {"name": name, "spark_rows": len(srows)}
    sql = E.oracle_sql().get(name)
    if sql is None:
        out["status"] = "no-oracle"
        return out
    dcols, drows = rows_of_duck(con, sql)
    out["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = "schema"
        out["detail"] = (scols, dcols)
        return out
    order = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in order) for r in drows]
    ss, ds = sorted(srows), sorted(drows)
    if ss == ds:
        out["status"] = "match"
    else:
        out["status"] = "values"
        only_s = [r for r in ss if r not in set(ds)][:3]
        only_d = [r for r in ds if r not in set(ss)][:3]
        out["detail"] = {"columns": scols, "spark_only": only_s, "oracle_only": only_d}
    return out


def main(argv: list[str]) -> int:
    from lateflow.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as E

    from lateflow.plans.registry import JOBS

    names = argv[1:] or list(JOBS)
    spark = get_session(os.environ.get("HARNESS_MASTER", "local[8]"), shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "error", "detail": repr(e)[:600]}
        if r["status"] not in ("match", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
