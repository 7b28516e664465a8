"""Root-cause questions over the order fact.

Every function is a lazy ``DataFrame -> DataFrame`` transform whose
thresholds are parameters defaulting to the reference's literals. Output
columns are typed exactly (BIGINT counts, DECIMAL rates and hours) and every
rounded value comes from integer sums through ``lateflow.functions.exact``.

Scale notes
-----------
* Grouped questions (Q1, Q3, Q7, Q8) are one hash aggregation with map-side
  partials: the shuffle carries one partial row per group per task.
* Totals that the reference takes with ``SUM(..) OVER ()`` over a whole
  table are scalar subqueries (``DataFrame.scalar()``) over the already
  grouped rows, so Spark reuses the grouping's exchange (one scan of the
  input) and no single-partition window ever sees the data.
* Windows without PARTITION BY run only on inputs bounded by a small domain
  -- months (Q4), states (Q5) or the ``top`` rows of a report (Q2) -- never
  on per-order or per-seller data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateflow.functions.exact import (
    RATE_SCALE,
    mean,
    mean_hours,
    pct,
    rate_scaled,
    round_ratio,
)
from lateflow.functions.expr import DEFAULT_BAND_EDGES, lateness_band


def _count() -> F.Column:
    return F.count(F.lit(1))


def _sum_int(c: str) -> F.Column:
    return F.sum(c).cast("bigint")


# --------------------------------------------------------------- raw orders


def status_mix(orders: DataFrame) -> DataFrame:
    """Orders per status with percent of all orders.

    The total is summed from the per-status rows (the reference's
    ``SUM(COUNT(*)) OVER ()``), so the orders are scanned once.
    """
    groups = orders.groupBy("order_status").agg(_count().alias("orders"))
    total = groups.select(F.sum("orders")).scalar()
    return groups.select("order_status", "orders", pct("orders", total).alias("pct_of_total")).orderBy(
        F.desc("orders"), F.asc_nulls_first("order_status")
    )


def late_rate(orders: DataFrame) -> DataFrame:
    """Headline late-delivery rate over delivered orders with a delivery stamp."""
    late = F.when(
        F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1
    ).otherwise(0)
    agg = orders.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    ).agg(_count().alias("delivered_orders"), F.sum(late).cast("bigint").alias("late_deliveries"))
    return agg.select(
        "delivered_orders", "late_deliveries", pct("late_deliveries", "delivered_orders").alias("late_rate_pct")
    )


# --------------------------------------------------------------- order fact


def fact_orders_summary(fact: DataFrame) -> DataFrame:
    """V5: rows, late orders, late rate, SLA misses, orders without a seller."""
    agg = fact.agg(
        _count().alias("fact_rows"),
        _sum_int("is_late").alias("late_orders"),
        _sum_int("missed_ship_sla").alias("missed_ship_sla"),
        F.count_if(F.col("seller_id").isNull()).alias("unattributed"),
    )
    return agg.select(
        "fact_rows",
        "late_orders",
        pct("late_orders", "fact_rows").alias("late_rate_pct"),
        "missed_ship_sla",
        "unattributed",
    )


def _hour_sums(*stages: str) -> list[F.Column]:
    out = []
    for s in stages:
        out += [F.sum(f"min_{s}").alias(f"_m_{s}"), F.count(f"min_{s}").alias(f"_n_{s}")]
    return out


def _hour_mean(stage: str, alias: str) -> F.Column:
    return mean_hours(f"_m_{stage}", f"_n_{stage}").alias(alias)


def stage_by_outcome(fact: DataFrame) -> DataFrame:
    """Q1: average stage hours for late vs on-time orders."""
    outcome = F.when(F.col("is_late") == 1, "Late").otherwise("On time")
    agg = fact.groupBy(outcome.alias("outcome")).agg(
        _count().alias("orders"), *_hour_sums("to_approve", "handling", "transit", "total_cycle")
    )
    return agg.select(
        "outcome",
        "orders",
        _hour_mean("to_approve", "avg_hrs_approve"),
        _hour_mean("handling", "avg_hrs_handling"),
        _hour_mean("transit", "avg_hrs_transit"),
        _hour_mean("total_cycle", "avg_hrs_total"),
    )


def lane_sla(fact: DataFrame) -> DataFrame:
    """Q3: late rate and stage hours by shipping lane x ship-SLA outcome."""
    agg = (
        fact.filter(F.col("seller_state").isNotNull())
        .groupBy("shipping_lane", "missed_ship_sla")
        .agg(_count().alias("orders"), _sum_int("is_late").alias("late_orders"), *_hour_sums("handling", "transit"))
    )
    return agg.select(
        "shipping_lane",
        "missed_ship_sla",
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        _hour_mean("handling", "avg_hrs_handling"),
        _hour_mean("transit", "avg_hrs_transit"),
    ).orderBy("shipping_lane", "missed_ship_sla")


def monthly(fact: DataFrame, min_orders: int = 100) -> DataFrame:
    """Orders and late orders per purchase month, gated by volume (before any window)."""
    return (
        fact.groupBy("purchase_month")
        .agg(_count().alias("orders"), _sum_int("is_late").alias("late_orders"))
        .filter(F.col("orders") >= min_orders)
        .withColumn("_rate", rate_scaled("late_orders", "orders"))
    )


def trend(fact: DataFrame, min_orders: int = 100, window: int = 3) -> DataFrame:
    """Q4: monthly late rate, moving average of the last ``window`` kept months
    (mean of monthly rates) and change vs the previous kept month.

    The windows run over at most one row per calendar month.
    """
    unit = 10**RATE_SCALE
    w = Window.orderBy("purchase_month")
    frame = w.rowsBetween(-(window - 1), Window.currentRow)
    m = monthly(fact, min_orders).withColumns(
        {
            "_sum3": F.sum("_rate").over(frame),
            "_n3": F.count("_rate").over(frame),
            "_prev": F.lag("_rate").over(w),
        }
    )
    return m.select(
        "purchase_month",
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        round_ratio("_sum3", F.col("_n3") * unit, 2, 5).alias("late_rate_3mo_avg"),
        round_ratio(F.col("_rate") - F.col("_prev"), F.lit(unit), 2, 5).alias("mom_change_pts"),
    ).orderBy("purchase_month")


def state_variance(fact: DataFrame, min_orders: int = 100, min_entities: int = 10) -> DataFrame:
    """Q5: origin states vs the unweighted mean rate of the qualifying states.

    ``min_entities`` (distinct sellers per state) keeps a single seller from
    posing as a regional effect. Distinct sellers are counted in two levels
    (state, seller) -> state, so a hot state is pre-aggregated per seller
    before it is shuffled. Windows run over one row per state.
    """
    unit = 10**RATE_SCALE
    per_seller = (
        fact.filter(F.col("seller_state").isNotNull())
        .groupBy("seller_state", "seller_id")
        .agg(_count().alias("_o"), _sum_int("is_late").alias("_l"), *_hour_sums("handling", "transit"))
    )
    sp = (
        per_seller.groupBy("seller_state")
        .agg(
            F.sum("_o").alias("orders"),
            F.count("seller_id").alias("seller_count"),
            F.sum("_l").alias("late_orders"),
            *[F.sum(f"_{k}_{s}").alias(f"_{k}_{s}") for s in ("handling", "transit") for k in ("m", "n")],
        )
        .filter((F.col("orders") >= min_orders) & (F.col("seller_count") >= min_entities))
        .withColumn("_rate", rate_scaled("late_orders", "orders"))
    )
    everything = Window.partitionBy()
    sp = sp.withColumns(
        {
            "_sum": F.sum("_rate").over(everything),
            "_k": F.count(F.lit(1)).over(everything),
            "worst_rank": F.rank().over(Window.orderBy(F.desc("_rate"))).cast("bigint"),
        }
    )
    return sp.select(
        "seller_state",
        "orders",
        "seller_count",
        pct("late_orders", "orders").alias("late_rate_pct"),
        round_ratio("_sum", F.col("_k") * unit, 2, 5).alias("national_avg_pct"),
        round_ratio(F.col("_rate") * F.col("_k") - F.col("_sum"), F.col("_k") * unit, 2, 5).alias(
            "variance_vs_national"
        ),
        _hour_mean("handling", "avg_hrs_handling"),
        _hour_mean("transit", "avg_hrs_transit"),
        "worst_rank",
    ).orderBy("worst_rank", "seller_state")


def dominance(
    fact: DataFrame, group: str = "seller_state", entity: str = "seller_id", weight: str | None = None, max_share_pct: int = 50
) -> DataFrame:
    """V8: whether a group's figures are those of one entity, whatever the number of entities.

    Per group: orders (or the sum of the 0/1 ``weight``), entities with any, the greatest entity with its
    share, and the Herfindahl index (sum of squared shares; 1 is a single entity). ``dominated`` marks
    groups whose greatest entity holds at least ``max_share_pct`` percent. Of equal entities the one with the greater id is named.
    Rows are counted by (group, entity) first, so a hot group or entity is reduced before it is shuffled.
    """
    n = _count() if weight is None else _sum_int(weight)
    rollup = fact.filter(F.col(group).isNotNull() & F.col(entity).isNotNull()).groupBy(group, entity).agg(n.alias("_n")).filter("_n > 0")
    square = F.col("_n").cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)")
    per_group = rollup.groupBy(group).agg(
        F.sum("_n").cast("bigint").alias("orders"),
        F.count(F.lit(1)).alias("entities"),
        F.max(F.struct("_n", entity)).alias("_top"),
        F.sum(square).cast("decimal(38,0)").alias("_squares"),
    )
    whole = F.col("orders").cast("decimal(19,0)") * F.col("orders").cast("decimal(19,0)")
    return per_group.select(
        group,
        "orders",
        "entities",
        F.col(f"_top.{entity}").alias("top_entity"),
        F.col("_top._n").alias("top_orders"),
        pct("_top._n", "orders").alias("top_share_pct"),
        round_ratio("_squares", whole, 4, 5).alias("herfindahl"),
        (F.col("_top._n") * 100 >= F.col("orders") * max_share_pct).alias("dominated"),
    ).orderBy(group)


def category_profile(
    fact: DataFrame,
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    min_orders: int = 200,
    top: int = 20,
) -> DataFrame:
    """Q6: late rate per product category, an order counted once per category.

    Order of work: items are restricted to fact orders and tagged with the
    order's is_late (join on order_id), then mapped to categories (join on
    product_id); the (category, order_id) de-duplication and the category
    count are two aggregation levels, so a hot category is pre-aggregated
    before its final shuffle. Ties at the cut are broken by category.
    """
    tagged = items.select("order_id", "product_id").join(fact.select("order_id", "is_late"), "order_id", "inner")
    cats = products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown")).alias("category"),
    )
    pairs = tagged.join(cats, "product_id", "inner").groupBy("category", "order_id").agg(F.max("is_late").alias("is_late"))
    agg = (
        pairs.groupBy("category")
        .agg(_count().alias("orders"), _sum_int("is_late").alias("_late"))
        .filter(F.col("orders") >= min_orders)
        .select("category", "orders", pct("_late", "orders").alias("late_rate_pct"))
    )
    return agg.orderBy(F.desc("late_rate_pct"), F.asc("category")).limit(top)


def lateness_bands(
    fact: DataFrame, edges=DEFAULT_BAND_EDGES, same_day_band: bool = True, reviewed_only: bool = True
) -> DataFrame:
    """Q7: review score and detractor rate by how late the order arrived."""
    df = fact.filter(F.col("review_score").isNotNull()) if reviewed_only else fact
    band = lateness_band("is_late", "days_late", edges, same_day_band)
    agg = df.groupBy(band.alias("lateness_band")).agg(
        _count().alias("orders"),
        F.sum("review_score").alias("_s"),
        F.count("review_score").alias("_n"),
        _sum_int("is_detractor").alias("_d"),
    )
    return agg.select(
        "lateness_band",
        "orders",
        mean("_s", "_n", 2, 4).alias("avg_review_score"),
        pct("_d", "orders").alias("detractor_rate_pct"),
    ).orderBy("lateness_band")


def sourcing_profile(fact: DataFrame) -> DataFrame:
    """Q8: single- vs multi-seller orders (reviewed, with items).

    ``seller_count = 1`` is Single; anything else is Multi.
    """
    sourcing = F.when(F.col("seller_count") == 1, "Single").otherwise("Multi")
    agg = (
        fact.filter(F.col("review_score").isNotNull() & F.col("line_count").isNotNull())
        .groupBy(sourcing.alias("sourcing"))
        .agg(
            _count().alias("orders_with_reviews"),
            _sum_int("is_late").alias("_late"),
            F.sum("review_score").alias("_s"),
            F.count("review_score").alias("_n"),
            _sum_int("is_detractor").alias("_d"),
        )
    )
    return agg.select(
        "sourcing",
        "orders_with_reviews",
        pct("_late", "orders_with_reviews").alias("late_rate_pct"),
        mean("_s", "_n", 2, 4).alias("avg_review_score"),
        pct("_d", "orders_with_reviews").alias("detractor_rate_pct"),
    )


__all__ = [
    "status_mix",
    "late_rate",
    "fact_orders_summary",
    "stage_by_outcome",
    "lane_sla",
    "monthly",
    "trend",
    "state_variance",
    "category_profile",
    "lateness_bands",
    "sourcing_profile",
]
