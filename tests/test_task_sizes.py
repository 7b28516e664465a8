"""What one task holds: partitions by order follow the number of items."""

from __future__ import annotations

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lateflow.operators import facts
from lateflow.plans import layout
from lateflow.plans.registry import Model
from lateflow.sources import testmap

from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(map(str, df.collect()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("o_orderdate"))
    lines = spark.range(200).selectExpr(
        "id % 45 AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id % 11 AS l_partkey", "id % 5 AS l_suppkey", "10.5D AS l_extendedprice", "0.04D AS l_tax"
    )
    return lines, orders


@pytest.mark.parametrize("each, n", [(10, 20), (33, 7), (100, 2)])
def test_items_are_dealt_by_their_number(monkeypatch, no_broadcast, tables, each, n):
    monkeypatch.setattr(testmap, "PARTITION_ITEMS", each)
    lines, orders = tables
    items = testmap.derive_order_items(lines, orders)
    p = plan(facts.binding_seller(items))
    dealt = re.findall(r"hashpartitioning\((?:l_orderkey|o_orderkey)#\d+L?, (\d+)\)", p)
    assert dealt == [str(n)] * 2 and "hashpartitioning(order_id" not in p
    once = orders.withColumnRenamed("o_orderkey", "l_orderkey")
    stamps = {(r["l_orderkey"], r["l_partkey"]): r["o_orderdate"] for r in lines.join(once, "l_orderkey", "left").collect()}
    got = items.select("order_id", "product_id", "shipping_limit_date").collect()
    assert len(got) == 200
    for r in got:
        bought = stamps[r["order_id"], r["product_id"]]
        assert r["shipping_limit_date"] == (bought and bought + dt.timedelta(days=r["product_id"] % 4 + 3))


def test_items_without_the_stamp_are_not_dealt(monkeypatch, no_broadcast, tables):
    monkeypatch.setattr(testmap, "PARTITION_ITEMS", 10)
    p = plan(facts.order_skus(testmap.derive_order_items(*tables)))
    assert "REPARTITION_BY_NUM" not in p and "o_orderkey" not in p


def test_lines_follow_the_dealt_orders(spark, no_broadcast):
    raw = Model(spark, SF001).raw
    assert raw.item_partitions == 1 and "item_partitions" not in raw.tables()
    fact = facts.fact_orders_from(raw)
    dealt = facts.fact_lines(raw.order_items, fact, raw.products, raw.product_category_translation, 9)
    narrow = plan(dealt.select("order_id", "product_id", "is_late"))
    assert len(re.findall(r"hashpartitioning\(order_id#\d+L?, 9\)", narrow)) == 2
    assert rows(dealt) == rows(facts.fact_lines(raw.order_items, fact, raw.products, raw.product_category_translation))


def test_buckets_grow_with_the_items(spark, monkeypatch, tmp_path):
    raw = Model(spark, SF001).raw
    monkeypatch.setattr(layout, "BUCKET_ROWS", -(-raw.order_items.count() // 11))
    stored = layout.store_by_order(spark, raw, str(tmp_path), buckets=2, database=f"by_order_{uuid.uuid4().hex[:8]}")
    assert stored.buckets == 11
    assert rows(layout.fact_orders_by_order(stored)) == rows(facts.fact_orders_from(raw))
