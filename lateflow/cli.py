"""Command line: the reference's script order as Spark jobs.

    python -m lateflow.cli load      --data-dir CSV_DIR --raw RAW_DIR   (or: python -m lateflow load ...)
    python -m lateflow.cli checks    --raw RAW_DIR
    python -m lateflow.cli build     --raw RAW_DIR --facts FACT_DIR
    python -m lateflow.cli questions --raw RAW_DIR --facts FACT_DIR [--monthly-gate N]
    python -m lateflow.cli sql       --raw RAW_DIR --facts FACT_DIR --query "SELECT ..." [--out PATH] [--limit N]

``load`` is the CSV ingest (full refresh, load report); ``checks`` the
row-count, schema, orphan and key checks; ``build`` writes both facts and
prints their summaries; ``questions`` prints every root-cause report;
``sql`` registers the stored layers as ``raw.*`` / ``analytics.*`` tables and
runs a SQL statement written against the reference's schema. Each
step is one or more Spark jobs; only the small reports reach the driver.
Paths may be any file system the session can read (local, HDFS, object
store); on a cluster pass the cluster's own master and settings through
``spark-submit``.
"""

from __future__ import annotations

import argparse
import sys

from lateflow.operators import diagnostics as T
from lateflow.operators import pareto as P
from lateflow.operators import quality as V
from lateflow.operators import questions as Q
from lateflow.session import get_session
from lateflow.sources.schemas import EXPECTED_ROWS, ORDERS


def _show(title: str, df, limit: int | None = None) -> None:
    """Print a report whole (reports are small by nature), or its first ``limit`` rows and that there are more."""
    print(f"\n== {title}")
    rows = (df if limit is None else df.limit(limit + 1)).collect()
    more = limit is not None and len(rows) > limit
    cells = [list(df.columns), *([str(v) for v in r] for r in (rows[:limit] if more else rows))]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    for r in cells:
        print("| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |")
    if more:
        print(f"... first {limit} rows; --out PATH writes the whole result")


def cmd_load(spark, args) -> None:
    from lateflow.sources.ingest import load_all

    _show("load report", load_all(spark, args.data_dir, args.raw))


def cmd_checks(spark, args) -> None:
    from lateflow.sources.ingest import read_raw

    raw = read_raw(spark, args.raw)
    _show("row counts", V.row_count_check(raw.tables(), EXPECTED_ROWS))
    _show("orders schema", V.schema_report(spark, raw.orders, ORDERS))
    _show("orphan order items", V.orphan_check(raw.order_items, raw.orders, "order_id"))
    keys = {
        "orders": (raw.orders, "order_id"),
        "customers": (raw.customers, "customer_id"),
        "products": (raw.products, "product_id"),
        "sellers": (raw.sellers, "seller_id"),
    }
    _show("keys", V.key_check(keys))
    _show("status mix", Q.status_mix(raw.orders))
    _show("late rate", Q.late_rate(raw.orders))


def cmd_build(spark, args) -> None:
    from lateflow.plans.materialize import build_facts
    from lateflow.sources.ingest import read_raw

    facts = build_facts(spark, read_raw(spark, args.raw), args.facts)
    _show("order fact", Q.fact_orders_summary(facts.orders(spark)))
    _show("line fact", V.fact_lines_summary(facts.lines(spark)))


def cmd_questions(spark, args) -> None:
    from lateflow.plans.materialize import Facts
    from lateflow.sources.ingest import read_raw

    raw = read_raw(spark, args.raw)
    root = args.facts.rstrip("/")
    stored = Facts(f"{root}/fact_order_fulfillment", f"{root}/fact_order_lines")
    fact, lines = stored.orders(spark), stored.lines(spark)
    gate = args.monthly_gate
    reports = {
        "Q1 stage hours by outcome": Q.stage_by_outcome(fact),
        "Q2 Pareto of late deliveries by seller": P.pareto(fact),
        "Q3 lane x ship SLA": Q.lane_sla(fact),
        "Q4 monthly trend": Q.trend(fact, min_orders=gate),
        "Q5 origin states vs baseline": Q.state_variance(fact),
        "Q6 category profile": Q.category_profile(
            fact, raw.order_items, raw.products, raw.product_category_translation
        ),
        "Q7 lateness band vs review": Q.lateness_bands(fact),
        "Q8 single vs multi-seller": Q.sourcing_profile(fact),
        "T1 chi-square (seller group x review group)": T.chi_square_test(raw.order_items, raw.order_reviews),
        "T1 cells": T.contingency_wide(
            T.seller_review_groups(raw.order_items, raw.order_reviews), "seller_group", "review_group", ["bad", "good"]
        ),
        "T2 recoverable defects": T.recoverable_defects(fact),
        "T3 category size profile": T.size_profile(lines),
        "T4 high-rate sellers": P.high_rate_sellers(fact),
        "T5 spike months": T.spike_months(fact, min_orders=gate),
        "T6 right-censoring": T.right_censoring(raw.orders),
    }
    for title, df in reports.items():
        _show(title, df)


def cmd_sql(spark, args) -> None:
    from lateflow.plans.catalog import register_tables

    register_tables(spark, args.raw, args.facts)
    result = spark.sql(args.query)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
        result = spark.read.parquet(args.out)
    _show("result", result, args.limit)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lateflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("load", help="CSV folder -> typed raw parquet")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--raw", required=True)
    p = sub.add_parser("checks", help="row counts, schema, orphans, keys")
    p.add_argument("--raw", required=True)
    p = sub.add_parser("build", help="order and line facts")
    p.add_argument("--raw", required=True)
    p.add_argument("--facts", required=True)
    p = sub.add_parser("questions", help="root-cause reports")
    p.add_argument("--raw", required=True)
    p.add_argument("--facts", required=True)
    p.add_argument("--monthly-gate", type=int, default=100)
    p = sub.add_parser("sql", help="run SQL against raw.* and analytics.* tables")
    p.add_argument("--raw", required=True)
    p.add_argument("--facts", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--out", default=None, help="write the whole result there, as parquet")
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    ap.add_argument("--master", default=None, help="Spark master (default: the session's)")
    args = ap.parse_args(argv)
    spark = get_session(master=args.master, app_name=f"lateflow-{args.cmd}")
    commands = {"load": cmd_load, "checks": cmd_checks, "build": cmd_build, "questions": cmd_questions, "sql": cmd_sql}
    commands[args.cmd](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
