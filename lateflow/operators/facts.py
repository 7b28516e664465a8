"""Fact builds: order grain (F1-F7), line grain (F8) and the two dims.

Plan shape of ``fact_orders`` (see README, "Plans"):

* items are rolled up by (order, seller) with hash aggregation and map-side
  partials, then by order: lines, sellers, money and the binding seller come
  from one scan of the items. A hot order is reduced per seller before its last
  shuffle, and is never sorted inside one task. Distinct SKUs are a second
  rollup by (order, product). No row is expanded;
* the latest review per order is ``max(struct(...))`` over reviews;
* customers join the orders and sellers join the per-order rollup (shuffled
  on their own keys); then orders, item rollup, SKUs and review all meet on
  ``order_id`` in one co-partitioned join stage, so the wide fact row is never
  re-shuffled;
* small dimension sides become broadcasts through Spark's own size check
  (``autoBroadcastJoinThreshold`` and AQE's runtime statistics), never by
  an unconditional hint, and stay sort-merge joins beyond it; AQE splits a
  skewed key's partition.

Unused joins disappear: each rollup is an aggregation unique on
``order_id``; with ``reduce_sides`` the customer / seller sides are reduced to
one row per key too (``one_per_key``), so a question planned straight from raw that reads
none of a side's columns drops that left join and its work -- Q7, for example, reads only orders and
reviews. The stored build joins the sides as they are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateflow.functions.expr import (
    days_between,
    epoch,
    flag,
    hours,
    minutes_between,
    month_start,
    shipping_lane,
    weekday_name,
)

ORDER_FACT_COLUMNS = (
    "order_id",
    "order_status",
    "purchase_date",
    "purchase_month",
    "purchase_weekday",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "hrs_to_approve",
    "hrs_handling",
    "hrs_transit",
    "hrs_total_cycle",
    "days_late",
    "is_late",
    "missed_ship_sla",
    "seller_id",
    "seller_state",
    "seller_city",
    "customer_state",
    "shipping_lane",
    "line_count",
    "seller_count",
    "distinct_skus",
    "item_value",
    "freight_value",
    "review_score",
    "is_detractor",
    # integer stage minutes kept beside the hours for exact averages
    "min_to_approve",
    "min_handling",
    "min_transit",
    "min_total_cycle",
)


# Packed order of item lines: microseconds of the shipping limit (+1; 0 where it
# is NULL), then the item number in 11 digits. A DECIMAL of fixed width, so that
# the maximum is a hash aggregation; NULLs sort lowest.
_ITEM_DIGITS = 10**11


def _line_order(limit: str, item: str) -> Column:
    micros = ((F.col(limit).cast("timestamp_ntz") - epoch()).cast("decimal(20,6)") * 1_000_000).cast("decimal(20,0)")
    number = (F.col(item).cast("bigint") + F.lit(2**31 + 1)).cast("decimal(11,0)")
    scale = F.lit(Decimal(_ITEM_DIGITS)).cast("decimal(12,0)")
    return (F.coalesce(micros + 1, F.lit(0)).cast("decimal(21,0)") * scale + F.coalesce(number, F.lit(0))).cast("decimal(34,0)")


def _limit_of(order: Column) -> Column:
    """The shipping limit back from a packed order."""
    micros = F.floor(order / F.lit(Decimal(_ITEM_DIGITS)).cast("decimal(12,0)")).cast("decimal(21,0)") - 1
    seconds = (micros / F.lit(Decimal(1_000_000)).cast("decimal(8,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.when(micros >= 0, epoch() + F.make_dt_interval(zero, zero, zero, seconds))


def order_item_rollup(items: DataFrame) -> DataFrame:
    """F1 and the seller half of F2 from one scan of the items, one row per order:
    ``seller_id`` and ``shipping_limit_date`` of the binding line, ``line_count``,
    ``seller_count``, ``item_value``, ``freight_value``.

    The binding line is the one with the latest shipping limit, then the
    greatest item number, then the greatest seller (item numbers need not be
    unique). NULLs sort lowest, as in the reference's ROW_NUMBER ... DESC.
    """
    per_seller = items.groupBy("order_id", "seller_id").agg(
        F.max(_line_order("shipping_limit_date", "order_item_id")).alias("_order"),
        F.count(F.lit(1)).alias("_lines"),
        F.sum("price").alias("_value"),
        F.sum("freight_value").alias("_freight"),
    )
    per_order = per_seller.groupBy("order_id").agg(
        F.max(F.struct("_order", "seller_id")).alias("_b"),
        F.sum("_lines").cast("bigint").alias("line_count"),
        F.count("seller_id").alias("seller_count"),
        F.sum("_value").cast("decimal(22,2)").alias("item_value"),
        F.sum("_freight").cast("decimal(22,2)").alias("freight_value"),
    )
    return per_order.select(
        "order_id",
        "_b.seller_id",
        _limit_of(F.col("_b._order")).alias("shipping_limit_date"),
        "line_count",
        "seller_count",
        "item_value",
        "freight_value",
    )


def order_skus(items: DataFrame) -> DataFrame:
    """Distinct SKUs per order, rolled up by (order, product) first."""
    return items.groupBy("order_id", "product_id").agg(F.lit(1).alias("_one")).groupBy("order_id").agg(F.count("product_id").alias("distinct_skus"))


def binding_seller(items: DataFrame) -> DataFrame:
    """per order, the seller and shipping limit of the binding item line."""
    return order_item_rollup(items).select("order_id", "seller_id", "shipping_limit_date")


def order_composition(items: DataFrame) -> DataFrame:
    """lines, distinct sellers, distinct SKUs, item value and freight per order."""
    joined = order_item_rollup(items).join(order_skus(items), "order_id", "left")
    return joined.select("order_id", "line_count", "seller_count", "distinct_skus", "item_value", "freight_value")


def latest_review(reviews: DataFrame, policy: str = "latest") -> DataFrame:
    """one review score per order.

    ``policy="latest"`` -- the most recent review (creation date DESC,
    review_id DESC as tie-break), as the order fact uses.
    ``policy="max"`` -- the highest score, as the significance test uses.
    Reviews without an order id are dropped.
    """
    r = reviews.filter(F.col("order_id").isNotNull())
    if policy == "latest":
        return (
            r.groupBy("order_id")
            .agg(F.max(F.struct("review_creation_date", "review_id", "review_score")).alias("_r"))
            .select("order_id", F.col("_r.review_score").alias("review_score"))
        )
    if policy == "max":
        return r.groupBy("order_id").agg(F.max("review_score").alias("review_score"))
    raise ValueError(f"unknown review policy {policy!r}")


def stage_durations(df: DataFrame) -> DataFrame:
    """stage minutes (boundary counts) and hours. May be negative or NULL."""
    stages = {
        "to_approve": ("order_purchase_timestamp", "order_approved_at"),
        "handling": ("order_approved_at", "order_delivered_carrier_date"),
        "transit": ("order_delivered_carrier_date", "order_delivered_customer_date"),
        "total_cycle": ("order_purchase_timestamp", "order_delivered_customer_date"),
    }
    cols = {f"min_{k}": minutes_between(a, b) for k, (a, b) in stages.items()}
    df = df.withColumns(cols)
    return df.withColumns({f"hrs_{k}": hours(f"min_{k}") for k in stages})


def defect_flags(df: DataFrame, detractor_max: int = 2, strict_nulls: bool = False) -> DataFrame:
    """days_late, is_late, missed_ship_sla, is_detractor.

    As in the reference a NULL operand makes a flag 0; ``strict_nulls=True``
    keeps it NULL instead.
    """
    preds = {
        "is_late": F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
        "missed_ship_sla": F.col("order_delivered_carrier_date") > F.col("shipping_limit_date"),
        "is_detractor": F.col("review_score") <= detractor_max,
    }
    build = (lambda p: p.cast("int")) if strict_nulls else flag
    return df.withColumns(
        {
            "days_late": days_between("order_estimated_delivery_date", "order_delivered_customer_date"),
            **{k: build(p) for k, p in preds.items()},
        }
    )


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: the row with the greatest remaining columns.

    The reference's primary keys guarantee one row per key (violations are
    reported by ``quality.key_check``), so on valid data this changes
    nothing. It tells Catalyst the side is unique on ``key``: a left join to
    it that contributes no column is then removed from the plan.
    """
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(key, "_row.*")


def fact_orders(
    orders: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    sellers: DataFrame,
    customers: DataFrame,
    detractor_max: int = 2,
    strict_nulls: bool = False,
    reduce_sides: bool = True,
    sides_last: bool = False,
    rollups: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """one row per delivered order with a customer delivery stamp.

    ``rollups``: ``order_item_rollup`` and ``order_skus`` of the items, where the caller has them
    already (several facts over the same items).

    With ``sides_last`` customers and sellers are joined after all parts by order have met: for raw
    tables that are bucketed by order, which then need no Exchange on the order.

    With ``reduce_sides`` a customer or seller key that occurs twice counts once
    (``quality.key_check`` reports such keys); without, it multiplies its orders, as the
    reference's joins do.
    """
    delivered = orders.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )
    # Customers meet the orders (by customer_id), sellers meet the per-order
    # item rollup (by seller_id); then every part is on order_id and the final
    # joins are co-partitioned. Rollups are unique on order_id, so a question
    # that reads none of a rollup's columns drops that left join (and its
    # aggregation) entirely.
    customer = customers.select("customer_id", "customer_state")
    seller = sellers.select("seller_id", "seller_state", "seller_city")
    if reduce_sides:
        customer, seller = one_per_key(customer, "customer_id"), one_per_key(seller, "seller_id")
    rolled, skus = rollups or (order_item_rollup(items), order_skus(items))
    base, attributed = delivered, rolled
    if not sides_last:
        base, attributed = base.join(customer, "customer_id", "left"), attributed.join(seller, "seller_id", "left")
    joined = (
        base.join(attributed, "order_id", "left")
        .join(skus, "order_id", "left")
        .join(latest_review(reviews, "latest"), "order_id", "left")
    )
    if sides_last:
        joined = joined.join(customer, "customer_id", "left").join(seller, "seller_id", "left")
    ts = F.col("order_purchase_timestamp")
    fact = joined.withColumns(
        {
            "purchase_date": F.to_date(ts),
            "purchase_month": month_start(ts),
            "purchase_weekday": weekday_name(ts),
            "shipping_lane": shipping_lane("seller_state", "customer_state"),
        }
    )
    fact = defect_flags(stage_durations(fact), detractor_max, strict_nulls)
    return fact.select(*ORDER_FACT_COLUMNS)


def fact_orders_from(raw, reduce_sides: bool = True) -> DataFrame:
    """F7 over a ``RawModel``."""
    return fact_orders(raw.orders, raw.order_items, raw.order_reviews, raw.sellers, raw.customers, reduce_sides=reduce_sides)


LINE_FACT_COLUMNS = (
    "order_id",
    "order_item_id",
    "product_id",
    "seller_id",
    "purchase_date",
    "is_late",
    "missed_ship_sla",
    "shipping_lane",
    "category_en",
    "weight_kg",
    "volume_litres",
    "price",
    "freight_value",
)


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> category (English name, else source name, else 'unknown') and size."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce(
            F.col("product_category_name_english"), F.col("product_category_name"), F.lit("unknown")
        ).alias("category_en"),
        (F.col("product_weight_g") / F.lit(1000.0)).alias("weight_kg"),
        (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm") / F.lit(1000.0)).alias(
            "volume_litres"
        ),
    )


def fact_lines(items: DataFrame, fact: DataFrame, products: DataFrame, translation: DataFrame, partitions: int | None = None) -> DataFrame:
    """F8: one row per item line of an order in the order fact.

    Order-level flags and lane come from the order fact (on a multi-seller
    order they describe the binding seller, not necessarily this line's).
    Items whose product is unknown are kept with category 'unknown'.

    With ``partitions`` the orders are dealt into that many by their key and the items follow, so
    that a task's join and rollups hold no more as the items grow.
    """
    order_cols = fact.select("order_id", "purchase_date", "is_late", "missed_ship_sla", "shipping_lane")
    if partitions:
        order_cols = order_cols.repartition(partitions, "order_id")
    lines = items.join(order_cols, "order_id", "inner").join(
        product_categories(products, translation), "product_id", "left"
    )
    return lines.withColumn("category_en", F.coalesce(F.col("category_en"), F.lit("unknown"))).select(
        *LINE_FACT_COLUMNS
    )


def fact_lines_from(raw, fact: DataFrame | None = None) -> DataFrame:
    fact = fact if fact is not None else fact_orders_from(raw)
    return fact_lines(raw.order_items, fact, raw.products, raw.product_category_translation, raw.item_partitions)


def dim_date(fact: DataFrame) -> DataFrame:
    """one row per calendar day between the first and last purchase date.

    The day range is bounded by the calendar span of the data (thousands of
    rows), not by its volume.
    """
    bounds = fact.agg(F.min("purchase_date").alias("lo"), F.max("purchase_date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.trunc("date", "MM").alias("month_start"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "EEEE").alias("weekday"),
    )


def dim_seller(sellers: DataFrame) -> DataFrame:
    """seller dimension shared by both facts."""
    return sellers.select("seller_id", "seller_city", "seller_state", "seller_zip_code_prefix")
