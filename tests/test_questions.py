"""Question semantics on small hand-made facts, plus invariants at sf0.01."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lateflow.functions.expr import BAND_LABELS
from lateflow.operators import diagnostics, pareto, questions
from lateflow.plans.registry import Model

from conftest import SF01

FACT_COLS = (
    "order_id long, seller_id long, seller_state string, purchase_month date, is_late int, days_late int, "
    "missed_ship_sla int, shipping_lane string, review_score int, is_detractor int, seller_count long, "
    "line_count long, min_handling long, min_transit long"
)


def _fact(spark, rows):
    return spark.createDataFrame(rows, FACT_COLS)


def _row(oid, seller, state, month, late, days=0, missed=0, lane="Inter-state", score=None, sellers=1):
    det = 1 if score is not None and score <= 2 else 0
    return (oid, seller, state, month, late, days, missed, lane, score, det, sellers, 1, 60, 120)


def test_state_rank_ties_share_rank(spark):
    m = dt.date(2018, 1, 1)
    rows = []
    oid = 0
    # each state: 2 sellers x 2 orders; A and B have 2 of 4 late (50%), C none
    for state, late in (("A", 1), ("B", 1), ("C", 0)):
        for s in range(2):
            for k in range(2):
                oid += 1
                rows.append(_row(oid, hash((state, s)) % 10_000, state, m, late if k == 0 else 0))
    out = questions.state_variance(_fact(spark, rows), min_orders=1, min_entities=1).collect()
    ranks = {r["seller_state"]: r["worst_rank"] for r in out}
    assert ranks == {"A": 1, "B": 1, "C": 3}
    nat = {r["national_avg_pct"] for r in out}
    assert nat == {Decimal("33.33")}  # unweighted mean of 50, 50, 0
    assert {r["seller_state"]: r["variance_vs_national"] for r in out}["C"] == Decimal("-33.33")


def test_state_needs_enough_sellers(spark):
    m = dt.date(2018, 1, 1)
    rows = [_row(i, 1 + i % 9, "X", m, i % 2) for i in range(200)]  # 200 orders, 9 sellers
    assert questions.state_variance(_fact(spark, rows)).count() == 0
    rows = [_row(i, 1 + i % 10, "X", m, i % 2) for i in range(200)]  # 10 sellers
    assert questions.state_variance(_fact(spark, rows)).count() == 1


def test_trend_windows_skip_gated_months(spark):
    rows, oid = [], 0
    volumes = {dt.date(2018, 1, 1): (4, 1), dt.date(2018, 2, 1): (1, 1), dt.date(2018, 3, 1): (4, 2)}
    for month, (n, late) in volumes.items():
        for k in range(n):
            oid += 1
            rows.append(_row(oid, 1, "S", month, 1 if k < late else 0))
    out = questions.trend(_fact(spark, rows), min_orders=2).collect()
    assert [r["purchase_month"] for r in out] == [dt.date(2018, 1, 1), dt.date(2018, 3, 1)]
    assert out[0]["mom_change_pts"] is None
    assert out[1]["mom_change_pts"] == Decimal("25.00")  # 50 - 25, February skipped
    assert out[1]["late_rate_3mo_avg"] == Decimal("37.50")  # mean of the two kept months


def test_band_regression_hours_late_same_day(spark):
    m = dt.date(2018, 1, 1)
    rows = [_row(1, 1, "S", m, 1, days=0, score=1), _row(2, 1, "S", m, 1, days=20, score=1), _row(3, 1, "S", m, 0, score=5)]
    got = {r["lateness_band"]: r["orders"] for r in questions.lateness_bands(_fact(spark, rows)).collect()}
    assert got == {BAND_LABELS[0]: 1, BAND_LABELS[1]: 1, BAND_LABELS[5]: 1}
    buggy = {r["lateness_band"]: r["orders"] for r in questions.lateness_bands(_fact(spark, rows), same_day_band=False).collect()}
    assert buggy == {BAND_LABELS[0]: 1, BAND_LABELS[5]: 2}


def test_sourcing_zero_sellers_is_multi(spark):
    m = dt.date(2018, 1, 1)
    rows = [_row(1, 1, "S", m, 0, score=5, sellers=0), _row(2, 1, "S", m, 0, score=5, sellers=1)]
    got = {r["sourcing"]: r["orders_with_reviews"] for r in questions.sourcing_profile(_fact(spark, rows)).collect()}
    assert got == {"Multi": 1, "Single": 1}


def test_recoverable_defects_arithmetic(spark):
    m = dt.date(2018, 1, 1)
    rows, oid = [], 0
    # lane: 10 met orders with 1 late (10%), 4 missed with 2 late -> expected 0.4, recoverable 1.6
    for k in range(10):
        oid += 1
        rows.append(_row(oid, 1, "S", m, 1 if k == 0 else 0, missed=0))
    for k in range(4):
        oid += 1
        rows.append(_row(oid, 1, "S", m, 1 if k < 2 else 0, missed=1))
    out = {r["shipping_lane"]: r for r in diagnostics.recoverable_defects(_fact(spark, rows)).collect()}
    lane = out["Inter-state"]
    assert lane["expected_late_at_met_rate"] == Decimal("0.40")
    assert lane["recoverable_late"] == Decimal("1.60")
    assert lane["recoverable_pct_of_late"] == Decimal("53.33")  # 1.6 of 3 late
    assert out["All lanes"]["recoverable_late"] == Decimal("1.60")


@pytest.fixture(scope="module")
def sf01(spark):
    return Model(spark, SF01)


def test_invariants_sf001(sf01):
    fact = sf01.fact
    n = fact.count()
    bands = questions.lateness_bands(fact, reviewed_only=False).agg(F.sum("orders")).first()[0]
    assert bands == n
    lanes = questions.lane_sla(fact).agg(F.sum("orders")).first()[0]
    assert lanes == fact.filter("seller_state IS NOT NULL").count()
    curve = pareto.pareto_full_curve(fact).orderBy(F.desc("seller_rank")).first()
    assert curve["cum_pct_of_all_defects"] == Decimal("100.00") and curve["pct_of_sellers"] == Decimal("100.00")
    line_orders = {r[0] for r in sf01.lines.select("order_id").distinct().collect()}
    fact_orders = {r[0] for r in fact.select("order_id").collect()}
    assert line_orders <= fact_orders


def test_fixture_self_check_numbers(sf01):
    # FIXTURES.md section 3 (sf0.01): 4,866 rows, 1,229 late, 670 missed, 73 without seller
    s = questions.fact_orders_summary(sf01.fact).first()
    assert (s["fact_rows"], s["late_orders"], s["missed_ship_sla"], s["unattributed"]) == (4866, 1229, 670, 73)
    counts = {(r["seller_group"], r["review_group"]): r["observed"] for r in diagnostics.chi_square_counts(
        sf01.raw.order_items, sf01.raw.order_reviews).collect()}
    assert counts == {("single", "bad"): 278, ("single", "good"): 409, ("multi", "bad"): 3138, ("multi", "good"): 5027}
