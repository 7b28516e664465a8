"""Statistical and what-if diagnostics.

T1  chi-square test of independence (distributed counts, closed-form statistic)
T2  recoverable defects: late orders that disappear if SLA misses performed at
    their own lane's SLA-met rate
T3  category size profile (weight, volume) against late rate
T5  spike classification: a high-rate month at flat volume vs a volume surge
T6  right-censoring: share of each purchase month not yet delivered
(T4, high-rate sellers, lives in ``lateflow.operators.pareto``.)
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateflow.functions.chisq import log_p_value
from lateflow.functions.exact import RATE_SCALE, WIDE, pct, round_ratio
from lateflow.functions.expr import month_start
from lateflow.operators.facts import latest_review

# ------------------------------------------------------------------ T1


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Observed counts of each (row, col) level pair present in ``df``."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("observed"))


def contingency_wide(df: DataFrame, row: str, col: str, levels: list | None = None) -> DataFrame:
    """The r x c table for display: one row per ``row`` level, one column per
    ``col`` level (0 where a pair is absent). Pass ``levels`` to skip the job
    that discovers the distinct ``col`` values."""
    wide = df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1)))
    return wide.fillna(0).orderBy(row)


def chi_square(df: DataFrame, row: str, col: str, correction: bool = True, extra: dict | None = None) -> DataFrame:
    """One-row chi-square test of independence between two categorical columns.

    Pearson's statistic needs every cell of the r x c grid, including empty
    ones; the grid is not materialised. Observed cells give their own terms,
    and an empty cell's term is its expected count, so all empty cells together give N less
    the expected counts of the observed ones:

        X2 = sum_{O>0} (O - E)^2 / E  +  N - sum_{O>0} E,    E = R_i C_j / N

    With ``correction`` and dof = 1 (a 2x2 table) Yates' correction is
    applied as SciPy does it, capped at |O - E|; all four cells share
    D = |O - E|, so

        X2 = max(0, D - 1/2)^2 * N * (sum_i 1/R_i) * (sum_j 1/C_j)

    where sum_i 1/R_i = sum_cells O / R_i^2. Margins are aggregations of the
    cell table joined back to it, so no task sees all cells, however many levels the
    columns have. ``extra`` maps names to further
    aggregate expressions over the cells (columns ``row``, ``col``, ``observed``).

    Output: n, dof, statistic, p_value, neg_log10_p (DOUBLE), then ``extra``.
    """
    extra = extra or {}
    cells = contingency(df, row, col)
    rows = cells.groupBy(F.col(row).alias("_row")).agg(F.sum("observed").alias("_r"))
    cols = cells.groupBy(F.col(col).alias("_col")).agg(F.sum("observed").alias("_c"))
    total = rows.select(F.sum("_r")).scalar()
    joined = cells.join(rows, F.col(row).eqNullSafe(F.col("_row"))).join(cols, F.col(col).eqNullSafe(F.col("_col")))
    o, r, c, n = F.col("observed").cast("double"), F.col("_r").cast("double"), F.col("_c").cast("double"), total.cast("double")
    e = r * c / n
    stats = joined.agg(
        F.sum("observed").cast("bigint").alias("n"),
        F.sum((o - e) * (o - e) / e).alias("_q"),
        F.sum(e).alias("_e"),
        F.sum(o / (r * r)).alias("_ir"),
        F.sum(o / (c * c)).alias("_ic"),
        F.max(F.abs(o - e)).alias("_d"),
        *[x.alias(k) for k, x in extra.items()],
    )
    # a level that is NULL is none, as for a distinct count
    levels_r, levels_c = rows.select(F.count("_row")).scalar(), cols.select(F.count("_col")).scalar()
    dof = ((levels_r - 1) * (levels_c - 1)).cast("bigint")
    stats = stats.withColumn("dof", dof)
    nd = F.col("n").cast("double")
    pearson = F.col("_q") + F.greatest(nd - F.col("_e"), F.lit(0.0))
    yates = F.pow(F.greatest(F.col("_d") - F.lit(0.5), F.lit(0.0)), 2) * nd * F.col("_ir") * F.col("_ic")
    statistic = F.when(F.col("dof") <= 0, F.lit(0.0)).when(F.lit(correction) & (F.col("dof") == 1), yates).otherwise(pearson)
    out = stats.select("n", "dof", statistic.alias("statistic"), *extra)
    out = out.withColumn("_log_p", log_p_value(F.col("statistic"), F.col("dof")))  # the long loops, once
    return out.select(
        "n",
        "dof",
        "statistic",
        F.exp("_log_p").alias("p_value"),
        (-F.col("_log_p") / F.lit(math.log(10.0))).alias("neg_log10_p"),
        *extra,
    )


def seller_review_groups(
    items: DataFrame,
    reviews: DataFrame,
    review_policy: str = "max",
    orders: DataFrame | None = None,
) -> DataFrame:
    """T1 population: orders with items and a review.

    seller_count = distinct sellers (multi if > 1); review = one score per
    order by ``review_policy`` (``"max"``, the test's default, or
    ``"latest"``, the order fact's), bad if <= 2 (a missing score counts as
    good). The default population is every order status; pass ``orders`` (for
    example the delivered orders of the fact) to restrict it -- the two
    definitions explain two different single-seller rates.
    """
    items = items.filter(F.col("order_id").isNotNull())
    if orders is not None:
        items = items.join(orders.select("order_id"), "order_id", "left_semi")
    spo = items.groupBy("order_id").agg(F.count_distinct("seller_id").alias("seller_count"))
    df = spo.join(latest_review(reviews, policy=review_policy), "order_id", "inner")
    return df.select(
        "order_id",
        F.when(F.col("seller_count") > 1, "multi").otherwise("single").alias("seller_group"),
        F.when(F.col("review_score") <= 2, "bad").otherwise("good").alias("review_group"),
    )


def chi_square_counts(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """The 2x2 table seller_group x review_group."""
    return contingency(seller_review_groups(items, reviews), "seller_group", "review_group")


def chi_square_stat(items: DataFrame, reviews: DataFrame, correction: bool = True) -> DataFrame:
    """Statistic, dof and the bad-review rate of each seller group (no p)."""
    groups = seller_review_groups(items, reviews)
    obs = F.col("observed")
    sg, rg = F.col("seller_group"), F.col("review_group")
    extra = {
        "_ns": F.sum(F.when(sg == "single", obs)),
        "_bs": F.sum(F.when((sg == "single") & (rg == "bad"), obs)),
        "_nm": F.sum(F.when(sg == "multi", obs)),
        "_bm": F.sum(F.when((sg == "multi") & (rg == "bad"), obs)),
    }
    test = chi_square(groups, "seller_group", "review_group", correction, extra)
    return test.select(
        "n",
        "dof",
        F.col("statistic").cast("decimal(18,4)").alias("chi2"),
        pct(F.coalesce(F.col("_bs"), F.lit(0)), "_ns", 1, 4).alias("single_bad_rate_pct"),
        pct(F.coalesce(F.col("_bm"), F.lit(0)), "_nm", 1, 4).alias("multi_bad_rate_pct"),
    )


def chi_square_test(items: DataFrame, reviews: DataFrame, correction: bool = True) -> DataFrame:
    """T1 with the p-value (the reference prints statistic, p and dof)."""
    groups = seller_review_groups(items, reviews)
    return chi_square(groups, "seller_group", "review_group", correction).select(
        "n", "dof", F.col("statistic").alias("chi2"), "p_value", "neg_log10_p"
    )


# ------------------------------------------------------------------ T2


def recoverable_defects(fact: DataFrame) -> DataFrame:
    """Per lane (Q3 population), late orders among SLA misses beyond what
    the lane's SLA-met rate predicts, plus an 'All lanes' row.

    A lane without SLA-met orders has no rate to predict from: its figures are NULL and
    ``lanes_without_rate`` counts it, also in the total, whose expected and
    recoverable orders leave it out.

    recoverable = missed_late - missed_orders * met_late / met_orders
    recoverable_pct_of_late is relative to every late order in the fact.
    """
    missed = F.col("missed_ship_sla") == 1
    late = F.col("is_late")
    # One pass over the fact: cells by (lane, attributed) -- at most two lanes
    # x two -- give both the per-lane figures and the fact-wide late total
    # (a window over those few rows, so the fact is not scanned again).
    cells = fact.groupBy("shipping_lane", F.col("seller_state").isNotNull().alias("_attributed")).agg(
        F.sum(late).cast("bigint").alias("_all_late"),
        F.count_if(~missed).alias("met_orders"),
        F.sum(F.when(~missed, late).otherwise(0)).cast("bigint").alias("met_late"),
        F.count_if(missed).alias("missed_orders"),
        F.sum(F.when(missed, late).otherwise(0)).cast("bigint").alias("missed_late"),
    )
    lanes = cells.withColumn("_total_late", F.sum("_all_late").over(Window.partitionBy())).filter(
        F.col("_attributed")
    )
    total_late = F.col("_total_late")
    w = lambda c: F.col(c).cast(WIDE)
    excess = w("missed_late") * w("met_orders") - w("missed_orders") * w("met_late")
    per_lane = lanes.select(
        "shipping_lane",
        "_total_late",
        "met_orders",
        "met_late",
        pct("met_late", "met_orders").alias("met_rate_pct"),
        "missed_orders",
        "missed_late",
        pct("missed_late", "missed_orders").alias("missed_rate_pct"),
        round_ratio(w("missed_orders") * w("met_late"), "met_orders", 2, 18).alias("expected_late_at_met_rate"),
        round_ratio(excess, "met_orders", 2, 18).alias("recoverable_late"),
        round_ratio(excess * 100, w("met_orders") * total_late, 2, 5).alias("recoverable_pct_of_late"),
        (F.col("met_orders") == 0).cast("bigint").alias("lanes_without_rate"),
    )
    cents = (F.col("recoverable_late") * 100).cast(WIDE)
    total = per_lane.agg(
        F.sum("met_orders").alias("met_orders"),
        F.sum("met_late").alias("met_late"),
        F.sum("missed_orders").alias("missed_orders"),
        F.sum("missed_late").alias("missed_late"),
        F.sum("expected_late_at_met_rate").cast("decimal(18,2)").alias("expected_late_at_met_rate"),
        F.sum("recoverable_late").cast("decimal(18,2)").alias("recoverable_late"),
        F.sum(cents).alias("_cents"),
        F.max("_total_late").alias("_total_late"),
        F.sum("lanes_without_rate").alias("lanes_without_rate"),
    ).select(
        F.lit("All lanes").alias("shipping_lane"),
        F.col("met_orders").cast("bigint").alias("met_orders"),
        F.col("met_late").cast("bigint").alias("met_late"),
        pct("met_late", "met_orders").alias("met_rate_pct"),
        F.col("missed_orders").cast("bigint").alias("missed_orders"),
        F.col("missed_late").cast("bigint").alias("missed_late"),
        pct("missed_late", "missed_orders").alias("missed_rate_pct"),
        "expected_late_at_met_rate",
        "recoverable_late",
        round_ratio("_cents", total_late, 2, 5).alias("recoverable_pct_of_late"),
        F.col("lanes_without_rate").cast("bigint").alias("lanes_without_rate"),
    )
    return per_lane.drop("_total_late").unionByName(total)


# ------------------------------------------------------------------ T3


def size_profile(lines: DataFrame, min_orders: int = 0) -> DataFrame:
    """Per category, average weight (kg) and volume (litres) per line, and
    the late rate per distinct order.

    Two aggregation levels, (category, order) then category, so distinct
    orders are counted without an Expand and a hot category is reduced per
    order before its last shuffle. Sizes are summed as DECIMAL so the means
    do not depend on summation order.
    """
    dec = "decimal(20,6)"
    per_order = lines.groupBy("category_en", "order_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.max("is_late").alias("_late"),
        F.sum(F.col("weight_kg").cast(dec)).alias("_w"),
        F.count("weight_kg").alias("_wn"),
        F.sum(F.col("volume_litres").cast(dec)).alias("_v"),
        F.count("volume_litres").alias("_vn"),
    )
    cat = (
        per_order.groupBy("category_en")
        .agg(
            F.sum("_lines").alias("lines"),
            F.count(F.lit(1)).alias("orders"),
            F.sum("_late").cast("bigint").alias("late_orders"),
            F.sum("_w").alias("_w"),
            F.sum("_wn").alias("_wn"),
            F.sum("_v").alias("_v"),
            F.sum("_vn").alias("_vn"),
        )
        .filter(F.col("orders") >= min_orders)
    )
    micro = lambda c: (F.col(c) * 1_000_000).cast(WIDE)
    return cat.select(
        "category_en",
        "lines",
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        round_ratio(micro("_w"), F.col("_wn") * 1_000_000, 3, 12).alias("avg_weight_kg"),
        round_ratio(micro("_v"), F.col("_vn") * 1_000_000, 3, 12).alias("avg_volume_litres"),
    ).orderBy(F.desc("late_rate_pct"), F.asc("category_en"))


# ------------------------------------------------------------------ T5


def spike_months(
    fact: DataFrame,
    min_orders: int = 100,
    lookback: int = 3,
    rate_factor: str = "1.5",
    volume_factor: str = "1.2",
) -> DataFrame:
    """T5: flag months whose late rate jumps against the trailing ``lookback``
    kept months, and say whether volume jumped with it.

    rate spike    : rate >= rate_factor * mean(trailing monthly rates)
    volume spike  : orders >= volume_factor * mean(trailing monthly orders)
    spike_type    : 'volume surge' (both), 'rate spike at flat volume' (rate
                    only), 'none', or NULL for months without history.
    Windows run over one row per kept month.
    """
    from lateflow.operators.questions import monthly

    unit = 10**RATE_SCALE
    w = Window.orderBy("purchase_month")
    prior = w.rowsBetween(-lookback, -1)
    m = monthly(fact, min_orders).withColumns(
        {
            "_prs": F.sum("_rate").over(prior),
            "_prn": F.count("_rate").over(prior),
            "_pos": F.sum("orders").over(prior),
        }
    )
    rf, vf = F.lit(Decimal(rate_factor)), F.lit(Decimal(volume_factor))
    rate_spike = F.col("_rate") * F.col("_prn") >= rf * F.col("_prs")
    volume_spike = F.col("orders") * F.col("_prn") >= vf * F.col("_pos")
    kind = (
        F.when(F.col("_prn") == 0, F.lit(None).cast("string"))
        .when(rate_spike & volume_spike, "volume surge")
        .when(rate_spike, "rate spike at flat volume")
        .otherwise("none")
    )
    return m.select(
        "purchase_month",
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        round_ratio("_prs", F.col("_prn") * unit, 2, 5).alias("trailing_rate_pct"),
        round_ratio("_pos", "_prn", 1, 18).alias("trailing_avg_orders"),
        kind.alias("spike_type"),
    ).orderBy("purchase_month")


# ------------------------------------------------------------------ T6

# Order statuses that end without a delivery (marketplace
# status vocabulary), so an order in them is not "still open".
CLOSED_STATUSES = ("canceled", "unavailable")


def right_censoring(orders: DataFrame, closed_statuses=CLOSED_STATUSES) -> DataFrame:
    """Per purchase month, orders not yet delivered (open) and their share.

    The order fact keeps delivered orders only, so months near the end of the
    data lose their slowest orders; a high open share marks such months.
    """
    delivered = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    open_ = F.col("order_delivered_customer_date").isNull() & ~F.coalesce(
        F.col("order_status").isin(*closed_statuses), F.lit(False)
    )
    agg = orders.groupBy(month_start("order_purchase_timestamp").alias("purchase_month")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(delivered).alias("delivered_orders"),
        F.count_if(open_).alias("open_orders"),
    )
    return agg.select(
        "purchase_month", "orders", "delivered_orders", "open_orders", pct("open_orders", "orders").alias("open_share_pct")
    ).orderBy("purchase_month")


__all__ = [
    "contingency",
    "chi_square",
    "seller_review_groups",
    "chi_square_counts",
    "chi_square_stat",
    "chi_square_test",
    "recoverable_defects",
    "size_profile",
    "spike_months",
    "contingency_wide",
    "right_censoring",
]
