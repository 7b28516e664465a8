"""Quality checks on hand-made tables: schema, orphans, keys, counts, reconcile."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import types as T

from lateflow.operators import quality
from lateflow.sources.schemas import ORDERS


def test_schema_check_flags_text_datetimes(spark):
    bad = T.StructType([T.StructField(f.name, T.StringType()) for f in ORDERS.fields][:-1])
    df = spark.createDataFrame([], bad)
    report = {r[0]: r for r in quality.schema_check(df, ORDERS)}
    assert report["order_id"][3] is True
    assert report["order_approved_at"][2] == "string" and report["order_approved_at"][3] is False
    assert report["order_estimated_delivery_date"][2] == "missing"
    assert quality.schema_report(spark, df, ORDERS).count() == len(ORDERS.fields)


def test_orphans_keys_and_counts(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "order_id string")
    child = spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "order_id string")
    assert quality.orphan_check(child, parent, "order_id").first()["orphan_rows"] == 3
    k = quality.key_check({"orders": (parent, "order_id")}).first()
    assert (k["rows"], k["null_keys"], k["distinct_keys"], k["duplicated_keys"], k["is_unique"]) == (4, 1, 2, 1, False)
    c = {r["table_name"]: r for r in quality.row_count_check({"orders": parent, "x": child}, {"orders": 4}).collect()}
    assert c["orders"]["matches"] is True and c["x"]["expected_rows"] is None and c["x"]["matches"] is None


def test_reconcile_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x", "y"), ("y", "y"), ("y", "z"), ("y", "y")], "a string, b string")
    got = {r["k"]: (r["n_a"], r["n_b"], r["diff"]) for r in quality.reconcile_labels(df, "k", F.col("a"), F.col("b"), "n").collect()}
    assert got == {"x": (1, 0, -1), "y": (3, 3, 0), "z": (0, 1, 1)}


def test_reconcile_compares_texts_but_carries_values(spark):
    at, later = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2, 0, 0, 0, 500_000)
    kind = "k int, n bigint, d decimal(10,2), e decimal(10,2), x double, t timestamp_ntz"
    a = spark.createDataFrame([(1, 5, Decimal("1.50"), Decimal("2.00"), 0.0, at), (2, None, None, None, None, None), (None, 7, None, None, 1.0, at)], kind)
    b = spark.createDataFrame([(1, 5, Decimal("1.50"), Decimal("2.00"), -0.0, later), (2, 6, None, None, None, None), (None, 7, None, None, 1.0, at)], kind.replace("e decimal(10,2)", "e decimal(10,3)"))
    found = quality.reconcile(a, b, ["k"])
    assert {tuple(r) for r in found.collect()} == {
        (1, "differs", "e", "2.00", "2.000"),
        (1, "differs", "x", "0.0", "-0.0"),
        (1, "differs", "t", "2020-01-01 00:00:00", "2020-01-02 00:00:00.5"),
        (2, "differs", "n", None, "6"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"cast\([ndt]#\d+L? as string\)", plan)


def test_reconcile_facts_rolls_the_items_up_once(spark):
    from lateflow.plans import registry
    from lateflow.sources import testmap

    from conftest import SF001

    counted = registry.JOBS["reconcile_facts"](spark, SF001)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in plan and "l_extendedprice" not in plan and "l_suppkey" not in plan
    raw = testmap.raw_model(spark, SF001)
    fact = registry.F7.fact_orders_from(raw)
    orders, reviews = registry._without_every(raw.orders, "order_id", 50), registry._without_every(raw.order_reviews, "order_id", 37)
    other = registry.F7.fact_orders(orders, raw.order_items, reviews, raw.sellers, raw.customers)
    rows = sorted(map(str, counted.collect()))
    assert rows and rows == sorted(map(str, quality.reconcile(fact, other, ["order_id"], buckets=256).collect()))
