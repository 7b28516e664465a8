"""Order and line fact edge rows (FIXTURES.md section 2) on hand-made tables."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from lateflow.operators import facts
from lateflow.sources.schemas import (
    CATEGORY_TRANSLATION,
    CUSTOMERS,
    ORDER_ITEMS,
    ORDER_REVIEWS,
    ORDERS,
    PRODUCTS,
    SELLERS,
    RawModel,
)

from conftest import ts


def _o(oid, cust, status, purchase, approved, carrier, delivered, estimated):
    return (oid, cust, status, ts(purchase), ts(approved), ts(carrier), ts(delivered), ts(estimated))


def _i(oid, item, product, seller, limit, price="10.00", freight="1.00"):
    return (oid, item, product, seller, ts(limit), Decimal(price), Decimal(freight))


@pytest.fixture(scope="module")
def raw(spark):
    d = "2018-01-01 "
    orders = [
        # on time to the minute: delivered exactly at the estimate
        _o("o1", "c1", "delivered", d + "10:00:00", d + "10:00:59", "2018-01-02 08:00:00", "2018-01-10 00:00:00", "2018-01-10 00:00:00"),
        # hours late on the promised day; carrier after the binding limit
        _o("o2", "c2", "delivered", d + "10:00:00", d + "11:00:00", "2018-01-05 09:00:00", "2018-01-10 15:00:00", "2018-01-10 00:00:00"),
        # approved NULL, carrier NULL
        _o("o3", "c1", "delivered", d + "10:00:00", None, None, "2018-01-20 00:00:00", "2018-01-10 00:00:00"),
        # no items
        _o("o4", "c2", "delivered", d + "10:00:00", d + "10:30:00", d + "12:00:00", "2018-01-03 00:00:00", "2018-01-10 00:00:00"),
        # not delivered / delivered without stamp
        _o("o5", "c1", "shipped", d + "10:00:00", d + "10:30:00", d + "12:00:00", None, "2018-01-10 00:00:00"),
        _o("o6", "c1", "delivered", d + "10:00:00", d + "10:30:00", d + "12:00:00", None, "2018-01-10 00:00:00"),
        # carrier before approval: negative handling, kept
        _o("o7", "c1", "delivered", d + "10:00:00", d + "12:00:00", d + "11:00:00", "2018-01-09 00:00:00", "2018-01-10 00:00:00"),
    ]
    items = [
        _i("o1", 1, "p1", "s1", "2018-01-03 00:00:00"),
        # two sellers with equal shipping limit: higher item id wins
        _i("o2", 1, "p2", "s1", "2018-01-04 00:00:00"),
        _i("o2", 2, "p3", "s2", "2018-01-04 00:00:00"),
        _i("o2", 3, "p2", "s2", "2018-01-04 00:00:00"),
        _i("o3", 1, "p9", "s1", "2018-01-04 00:00:00"),  # unknown product
        _i("o7", 1, "p4", "s2", "2018-01-04 00:00:00"),
        _i("o7", 2, "p5", "s2", "2018-01-04 00:00:00"),
    ]
    reviews = [
        ("r1", "o1", 5, None, None, ts("2018-01-11 00:00:00"), None),
        # two reviews: newest wins in the fact, max wins for the chi-square population
        ("r2", "o2", 4, None, None, ts("2018-01-11 00:00:00"), None),
        ("r3", "o2", 1, None, None, ts("2018-01-12 00:00:00"), None),
        ("r4", None, 1, None, None, ts("2018-01-12 00:00:00"), None),
    ]
    customers = [("c1", "u1", None, "x", "SP"), ("c2", "u2", None, "y", "RJ")]
    sellers = [("s1", None, "a", "SP"), ("s2", None, "b", "MG")]
    products = [
        ("p1", "audio", None, None, None, 1200.0, 10.0, 10.0, 10.0),
        ("p2", "moveis", None, None, None, None, None, None, None),  # no translation
        ("p3", None, None, None, None, 500.0, 5.0, 2.0, 1.0),  # NULL category
        ("p4", "audio", None, None, None, 100.0, 1.0, 1.0, 1.0),
        ("p5", "audio", None, None, None, 100.0, 1.0, 1.0, 1.0),
    ]
    translation = [("audio", "audio_en")]
    mk = spark.createDataFrame
    return RawModel(
        orders=mk(orders, ORDERS),
        order_items=mk(items, ORDER_ITEMS),
        order_reviews=mk(reviews, ORDER_REVIEWS),
        customers=mk(customers, CUSTOMERS),
        sellers=mk(sellers, SELLERS),
        products=mk(products, PRODUCTS),
        product_category_translation=mk(translation, CATEGORY_TRANSLATION),
    )


@pytest.fixture(scope="module")
def fact_rows(raw):
    return {r["order_id"]: r for r in facts.fact_orders_from(raw).collect()}


def test_fact_population(fact_rows):
    assert set(fact_rows) == {"o1", "o2", "o3", "o4", "o7"}


def test_on_time_to_the_minute(fact_rows):
    r = fact_rows["o1"]
    assert r["is_late"] == 0 and r["days_late"] == 0
    assert r["min_to_approve"] == 0  # 10:00:00 -> 10:00:59 crosses no minute boundary
    assert r["purchase_weekday"] == "Monday"
    assert str(r["purchase_month"]) == "2018-01-01"


def test_binding_seller_and_same_day_lateness(fact_rows):
    r = fact_rows["o2"]
    assert r["seller_id"] == "s2"  # equal limits: item 3 (seller s2) wins
    assert r["is_late"] == 1 and r["days_late"] == 0
    assert r["missed_ship_sla"] == 1
    assert r["line_count"] == 3 and r["seller_count"] == 2 and r["distinct_skus"] == 2
    assert r["item_value"] == Decimal("30.00")
    assert r["review_score"] == 1 and r["is_detractor"] == 1  # newest review
    assert r["shipping_lane"] == "Inter-state"


def test_null_stamps(fact_rows):
    r = fact_rows["o3"]
    assert r["hrs_to_approve"] is None and r["hrs_handling"] is None and r["hrs_transit"] is None
    assert r["missed_ship_sla"] == 0  # NULL carrier counts as met
    assert r["is_late"] == 1 and r["days_late"] == 10
    assert r["review_score"] is None and r["is_detractor"] == 0
    assert r["shipping_lane"] == "Intra-state"


def test_order_without_items(fact_rows):
    r = fact_rows["o4"]
    assert r["seller_id"] is None and r["line_count"] is None and r["seller_count"] is None
    assert r["shipping_lane"] == "Inter-state"
    assert r["missed_ship_sla"] == 0


def test_negative_handling_kept(fact_rows):
    r = fact_rows["o7"]
    assert r["min_handling"] == -60 and r["hrs_handling"] == -1.0


def test_strict_nulls_option(raw):
    f = facts.fact_orders(raw.orders, raw.order_items, raw.order_reviews, raw.sellers, raw.customers, strict_nulls=True)
    r = {x["order_id"]: x for x in f.collect()}
    assert r["o3"]["missed_ship_sla"] is None and r["o3"]["is_detractor"] is None


def test_latest_vs_max_review(raw):
    latest = {r["order_id"]: r["review_score"] for r in facts.latest_review(raw.order_reviews).collect()}
    best = {r["order_id"]: r["review_score"] for r in facts.latest_review(raw.order_reviews, "max").collect()}
    assert latest == {"o1": 5, "o2": 1} and best == {"o1": 5, "o2": 4}


def test_line_fact(raw):
    fact = facts.fact_orders_from(raw)
    lines = facts.fact_lines_from(raw, fact).collect()
    by = {(r["order_id"], r["order_item_id"]): r for r in lines}
    assert len(lines) == 7  # o4 has no items; o5/o6 not in the fact
    assert by[("o1", 1)]["category_en"] == "audio_en" and by[("o1", 1)]["weight_kg"] == 1.2
    assert by[("o1", 1)]["volume_litres"] == 1.0
    assert by[("o2", 1)]["category_en"] == "moveis"  # untranslated name
    assert by[("o2", 2)]["category_en"] == "unknown"  # NULL category
    assert by[("o3", 1)]["category_en"] == "unknown"  # unknown product kept
    # order-level flags on every line (binding seller's SLA, not the line's)
    assert by[("o2", 1)]["missed_ship_sla"] == 1 and by[("o2", 1)]["seller_id"] == "s1"


def test_duplicate_translation_fans_out(spark, raw):
    dup = raw.product_category_translation.unionByName(
        spark.createDataFrame([("audio", "audio_alt")], CATEGORY_TRANSLATION)
    )
    lines = facts.fact_lines(raw.order_items, facts.fact_orders_from(raw), raw.products, dup)
    assert lines.filter("order_id = 'o1'").count() == 2


def test_dim_date_spans_purchase_dates(spark):
    df = spark.createDataFrame(
        [("2018-01-30",), ("2018-02-02",)], T.StructType([T.StructField("d", T.StringType())])
    ).selectExpr("to_date(d) AS purchase_date")
    days = facts.dim_date(df).collect()
    assert [str(r["date"]) for r in days] == ["2018-01-30", "2018-01-31", "2018-02-01", "2018-02-02"]
    assert days[2]["month_start"].isoformat() == "2018-02-01" and days[2]["weekday"] == "Thursday"


def test_opt_in_collation_matches_case_and_trailing_blanks(spark, raw):
    from lateflow.sources.schemas import with_collation

    mixed = RawModel(
        **{
            **{f: getattr(raw, f) for f in ("orders", "order_items", "order_reviews", "products", "product_category_translation")},
            "customers": spark.createDataFrame([("c1", "u1", None, "x", "sp "), ("c2", "u2", None, "y", "RJ")], CUSTOMERS),
            "sellers": spark.createDataFrame([("s1", None, "a", "SP"), ("s2", None, "b", "mg")], SELLERS),
        }
    )
    binary = {r["order_id"]: r["shipping_lane"] for r in facts.fact_orders_from(mixed).collect()}
    collated = {r["order_id"]: r["shipping_lane"] for r in facts.fact_orders_from(with_collation(mixed)).collect()}
    assert binary["o1"] == "Inter-state"  # 'SP' vs 'sp ' differ byte-wise
    assert collated["o1"] == "Intra-state"
