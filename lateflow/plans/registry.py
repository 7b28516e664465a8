"""Named jobs: every operator of the inventory as ``(spark, sf_dir) -> DataFrame``.

Each job derives the raw model from the tables under ``sf_dir`` and composes
the library's lazy transforms on top, so Catalyst sees one plan per job and
prunes what the job does not read (unused columns, and rollup joins that
contribute no column). Jobs on stored forms of the raw layer (CSV, by order) write them
under the shared checkpoint folder first.

Registered parameters are the reference's defaults. Jobs named ``..._gate_50``,
``..._gaps`` and the like are the same operators with other parameters or on
tables with rows taken out, so that branches are exercised which the defaults
never reach on small data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.functions.expr import lateness_band
from lateflow.operators import diagnostics as T
from lateflow.operators import facts as F7
from lateflow.operators import pareto as P
from lateflow.operators import quality as V
from lateflow.operators import questions as Q
from lateflow.plans import layout as L
from lateflow.plans import roundtrip as R
from lateflow.session import checkpoint_root, scratch_path
from lateflow.sources.schemas import EXPECTED_ROWS, ORDERS, RawModel
from lateflow.sources.testmap import raw_model

Job = Callable[[SparkSession, str], DataFrame]


class Model:
    """Raw model plus facts for one (session, source).

    ``fact`` is the lazy order-fact plan, ``lines`` the lazy line fact.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.raw: RawModel = raw_model(spark, sf_dir, full=True)
        self._fact = None
        self._lines = None

    @property
    def fact(self) -> DataFrame:
        if self._fact is None:
            self._fact = F7.fact_orders_from(self.raw)
        return self._fact

    @property
    def lines(self) -> DataFrame:
        if self._lines is None:
            self._lines = F7.fact_lines_from(self.raw, self.fact)
        return self._lines


def _job(fn: Callable[[Model], DataFrame]) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Model(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "job")
    run.__doc__ = fn.__doc__
    return run


def _stage_durations(m: Model) -> DataFrame:
    cols = ["order_id"] + [f"{p}_{s}" for p in ("min", "hrs") for s in ("to_approve", "handling", "transit", "total_cycle")]
    return F7.stage_durations(m.raw.orders).select(*cols)


def _row_counts(m: Model) -> DataFrame:
    return V.row_count_check(m.raw.tables(), EXPECTED_ROWS)


def _key_check(m: Model) -> DataFrame:
    r = m.raw
    return V.key_check(
        {
            "orders": (r.orders, "order_id"),
            "customers": (r.customers, "customer_id"),
            "products": (r.products, "product_id"),
            "sellers": (r.sellers, "seller_id"),
        }
    )


def _chi_square_test(m: Model) -> DataFrame:
    # The p-value is reported as -log10(p) to 4 places, a form two engines
    # agree on (the double itself differs in its last bits between them).
    test = T.chi_square_test(m.raw.order_items, m.raw.order_reviews)
    return test.select(
        "n",
        "dof",
        F.col("chi2").cast("decimal(18,4)").alias("chi2"),
        F.col("neg_log10_p").cast("decimal(12,4)").alias("neg_log10_p"),
    )


def _reconcile_bands(m: Model) -> DataFrame:
    reviewed = m.fact.filter(F.col("review_score").isNotNull())
    return V.reconcile_labels(
        reviewed, "lateness_band", lateness_band(), lateness_band(same_day_band=False), "orders", names=("fixed", "buggy")
    )


def _reconcile_facts(m: Model) -> DataFrame:
    """Differences between the order fact and one built from raw tables that lack every 50th order and the reviews of every 37th.

    The items are the same on both sides and are rolled up once: left to the plan, the filter on the orders
    reaches the items of one side only, and no exchange of the rollups is shared.
    """
    checkpoint_root(m.spark)
    r = m.raw
    rollups = F7.order_item_rollup(r.order_items).checkpoint(), F7.order_skus(r.order_items).checkpoint()

    def fact(orders: DataFrame, reviews: DataFrame) -> DataFrame:
        return F7.fact_orders(orders, r.order_items, reviews, r.sellers, r.customers, rollups=rollups)

    other = fact(_without_every(r.orders, "order_id", 50), _without_every(r.order_reviews, "order_id", 37))
    return V.reconcile(fact(r.orders, r.order_reviews), other, ["order_id"], buckets=256)


def _state_dominance(m: Model) -> DataFrame:
    """Dominance by state where one seller in three of each state holds nearly all of it: those sellers' orders count as one seller's."""
    one = F.when(F.col("seller_id") % 3 != 0, F.lit(-1).cast("bigint")).otherwise(F.col("seller_id"))
    return Q.dominance(m.fact.withColumn("seller_id", one), max_share_pct=60)


def _by_order(m: Model) -> L.OrderLayout:
    """The raw layer by order, in a folder of its own; orders of more than six lines stand apart as if they were hot."""
    root = scratch_path(m.spark, "by-order")
    return L.store_by_order(m.spark, m.raw, root, buckets=8, hot_rows=6, database=f"by_order_{root.rsplit('-', 1)[1]}")


def _without_every(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` without the rows whose key is a multiple of ``n``."""
    return df.filter(F.col(key) % n != 0)


def _lines_gaps(m: Model) -> DataFrame:
    """Line fact where every fifth product is unknown."""
    products = _without_every(m.raw.products, "product_id", 5)
    return F7.fact_lines(m.raw.order_items, m.fact, products, m.raw.product_category_translation, m.raw.item_partitions)


def _key_check_bad(m: Model) -> DataFrame:
    """Key check over customers of which every tenth occurs twice and every seventh has no key."""
    k = F.col("customer_id")
    twice = m.raw.customers.unionByName(m.raw.customers.filter(k % 10 == 0))
    bad = twice.withColumn("customer_id", F.when(k % 7 != 0, k))
    return V.key_check({"customers": (bad, "customer_id")})


def _t1_latest_delivered(m: Model) -> DataFrame:
    """T1's cells for delivered orders with the latest review."""
    groups = T.seller_review_groups(m.raw.order_items, m.raw.order_reviews, review_policy="latest", orders=m.fact)
    return T.contingency(groups, "seller_group", "review_group")


def _t1_pearson(m: Model) -> DataFrame:
    """Pearson's test of an r x c table: customer state against order status, with its deep tail."""
    orders = m.raw.orders.join(m.raw.customers.select("customer_id", "customer_state"), "customer_id")
    test = T.chi_square(orders, "customer_state", "order_status")
    return test.select("n", "dof", F.col("statistic").cast("decimal(18,4)").alias("chi2"), F.col("neg_log10_p").cast("decimal(12,3)").alias("neg_log10_p"))


JOBS: dict[str, Job] = {
    # sources and raw-layer questions
    "status_mix": _job(lambda m: Q.status_mix(m.raw.orders)),
    "late_rate": _job(lambda m: Q.late_rate(m.raw.orders)),
    "row_counts": _job(_row_counts),
    "key_check": _job(_key_check),
    "orphan_check": _job(lambda m: V.orphan_check(m.raw.order_items, m.raw.orders, "order_id")),
    # fact-building blocks
    "binding_seller": _job(lambda m: F7.binding_seller(m.raw.order_items)),
    "order_composition": _job(lambda m: F7.order_composition(m.raw.order_items)),
    "latest_review": _job(lambda m: F7.latest_review(m.raw.order_reviews)),
    "stage_durations": _job(_stage_durations),
    "defect_flags": _job(
        lambda m: m.fact.select("order_id", "days_late", "is_late", "missed_ship_sla", "is_detractor")
    ),
    "fact_orders": _job(lambda m: m.fact),
    "fact_orders_summary": _job(lambda m: Q.fact_orders_summary(m.fact)),
    "fact_lines": _job(lambda m: m.lines),
    "fact_lines_summary": _job(lambda m: V.fact_lines_summary(m.lines)),
    "dim_date": _job(lambda m: F7.dim_date(m.fact)),
    "dim_seller": _job(lambda m: F7.dim_seller(m.raw.sellers)),
    # root-cause questions
    "q1_stage_by_outcome": _job(lambda m: Q.stage_by_outcome(m.fact)),
    "q2_pareto": _job(lambda m: P.pareto(m.fact)),
    "pareto_full_curve": _job(lambda m: P.pareto_full_curve(m.fact)),
    "q3_lane_sla": _job(lambda m: Q.lane_sla(m.fact)),
    "q4_trend": _job(lambda m: Q.trend(m.fact)),
    "q5_state_variance": _job(lambda m: Q.state_variance(m.fact)),
    "q6_category": _job(
        lambda m: Q.category_profile(m.fact, m.raw.order_items, m.raw.products, m.raw.product_category_translation)
    ),
    "q7_lateness_band": _job(lambda m: Q.lateness_bands(m.fact)),
    "q8_sourcing": _job(lambda m: Q.sourcing_profile(m.fact)),
    "reconcile_bands": _job(_reconcile_bands),
    "reconcile_facts": _job(_reconcile_facts),
    "state_dominance": _job(lambda m: Q.dominance(m.fact)),
    "state_dominance_one_seller": _job(_state_dominance),
    # both facts from the raw layer laid out by order
    "fact_orders_by_order": _job(lambda m: L.fact_orders_by_order(_by_order(m))),
    "fact_lines_by_order": _job(lambda m: L.fact_lines_by_order(_by_order(m))),
    # diagnostics
    "chi_square_counts": _job(lambda m: T.chi_square_counts(m.raw.order_items, m.raw.order_reviews)),
    "chi_square_stat": _job(lambda m: T.chi_square_stat(m.raw.order_items, m.raw.order_reviews)),
    "chi_square_test": _job(_chi_square_test),
    "recoverable_defects": _job(lambda m: T.recoverable_defects(m.fact)),
    "size_profile": _job(lambda m: T.size_profile(m.lines)),
    "high_rate_sellers": _job(lambda m: P.high_rate_sellers(m.fact)),
    "spike_months": _job(lambda m: T.spike_months(m.fact)),
    "right_censoring": _job(lambda m: T.right_censoring(m.raw.orders)),
    # the same operators where their rarer branches occur
    "q4_trend_gate_50": _job(lambda m: Q.trend(m.fact, min_orders=50)),
    "spike_months_gate_50": _job(lambda m: T.spike_months(m.fact, min_orders=50)),
    "spike_months_low_factors": _job(
        lambda m: T.spike_months(m.fact, min_orders=50, rate_factor="1.05", volume_factor="1.02")
    ),
    "q5_state_gate_1000": _job(lambda m: Q.state_variance(m.fact, min_orders=1000)),
    "orphan_check_gaps": _job(
        lambda m: V.orphan_check(m.raw.order_items, _without_every(m.raw.orders, "order_id", 7), "order_id")
    ),
    "key_check_bad": _job(_key_check_bad),
    "fact_lines_gaps": _job(_lines_gaps),
    "fact_lines_summary_gaps": _job(lambda m: V.fact_lines_summary(_lines_gaps(m))),
    "q6_category_gaps": _job(
        lambda m: Q.category_profile(
            m.fact,
            m.raw.order_items,
            _without_every(m.raw.products, "product_id", 5),
            m.raw.product_category_translation,
            min_orders=100,
        )
    ),
    "chi_square_latest_delivered": _job(_t1_latest_delivered),
    "chi_square_pearson": _job(_t1_pearson),
    # the raw layer through CSV files
    "csv_round_trip": _job(lambda m: R.round_trip_report(m.spark, m.raw)),
    "csv_round_trip_orders": _job(lambda m: R.round_trip(m.spark, m.raw, "orders")),
    "csv_round_trip_items": _job(lambda m: R.round_trip(m.spark, m.raw, "order_items")),
    "csv_round_trip_reviews": _job(lambda m: R.round_trip_reviews(m.spark, m.raw)),
    "csv_dirty_cells": _job(lambda m: R.dirty_cells(m.spark, m.raw)),
    "load_rejects": _job(lambda m: R.load_rejects(m.spark, m.raw)),
    "load_report": _job(lambda m: R.malformed_report(m.spark, m.raw)),
    "schema_report": _job(lambda m: V.schema_report(m.spark, R.round_trip(m.spark, m.raw, "orders"), ORDERS)),
}

# Jobs whose output has no SQL equivalent in the oracle engine (none today).
NO_ORACLE: frozenset[str] = frozenset()

FLAGSHIP = "q3_lane_sla"
