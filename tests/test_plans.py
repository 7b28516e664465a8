"""Plan shape: pruning, pushdown, no whole-table windows, eliminated joins."""

from __future__ import annotations

import pytest

from lateflow.operators import facts, pareto, questions
from lateflow.plans.materialize import build_fact_orders
from lateflow.plans.registry import JOBS, Model
from lateflow.sources import versions

from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "fact_order_fulfillment")
    build_fact_orders(Model(spark, SF001).raw, path)
    return spark.read.parquet(versions.current(spark, path))


def test_question_scan_is_pruned_and_filtered(stored_fact):
    p = plan(questions.lane_sla(stored_fact))
    assert "PushedFilters: [IsNotNull(seller_state)]" in p
    scan = next(line for line in p.splitlines() if "FileScan parquet" in line)
    for unused in ("review_score", "item_value", "order_status", "hrs_total_cycle"):
        assert unused not in scan


def test_pareto_report_is_top_k_not_a_global_window(stored_fact):
    p = plan(pareto.pareto(stored_fact))
    assert "TakeOrderedAndProject" in p
    # the only windows run above the limit (over at most `top` rows)
    before_limit = p.split("TakeOrderedAndProject")[1]
    assert "Window" not in before_limit


def test_binding_seller_and_review_use_aggregates_not_windows(spark):
    m = Model(spark, SF001)
    p = plan(facts.fact_orders_from(m.raw))
    assert "Window" not in p and "WindowGroupLimit" not in p


def test_unused_rollups_are_eliminated(spark):
    p = plan(questions.lateness_bands(Model(spark, SF001).fact))  # over the lazy fact plan
    assert "Expand" not in p  # no composition (distinct counts) for Q7


def test_items_are_rolled_up_by_hash_from_one_scan(spark, tmp_path_factory):
    from lateflow.plans.materialize import store_raw

    items = store_raw(spark, Model(spark, SF001).raw, str(tmp_path_factory.mktemp("raw"))).order_items
    p = plan(facts.order_item_rollup(items))
    assert p.count("FileScan parquet") == 1 and "Expand" not in p
    # what sorts is the rollup of (order, seller), never the item lines
    per_item = [line for line in p.splitlines() if "keys=[order_id" in line and "seller_id" in line.split("functions=")[0]]
    assert per_item and all("HashAggregate" in line for line in per_item)
    whole = plan(facts.order_composition(items))
    assert whole.count("FileScan parquet") == 2 and "Expand" not in whole  # sellers and SKUs


@pytest.mark.parametrize("job", ["row_counts", "order_composition", "chi_square_counts", "q6_category"])
def test_items_do_not_join_orders_for_a_stamp_they_do_not_read(spark, job):
    p = JOBS[job](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "_purchase" not in p


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
EMPTY = {"q4_trend", "spike_months"}  # no month of the small tables reaches the gate of 100 orders
SMALL = {"q4_trend_gate_50", "spike_months_gate_50", "spike_months_low_factors", "q6_category", "q6_category_gaps", "q5_state_variance",
         "q5_state_gate_1000", "q2_pareto", "pareto_full_curve", "high_rate_sellers"}  # gated out at sf0.001


def test_every_job_runs_at_sf0001_and_stays_on_the_jvm(spark):
    for name, job in JOBS.items():
        df = job(spark, SF001)
        assert len(df.collect()) > 0 or name in EMPTY | SMALL, name
        p = plan(df)  # the final (executed) plan
        assert not {n for n in PYTHON_NODES if n in p}, name


def test_fact_build_pushes_the_delivered_filter_into_the_scan(spark, tmp_path_factory):
    from lateflow.plans.materialize import store_raw

    raw = store_raw(spark, Model(spark, SF001).raw, str(tmp_path_factory.mktemp("raw")))
    p = plan(facts.fact_orders_from(raw))
    scan = next(line for line in p.splitlines() if "FileScan parquet" in line and "order_status" in line)
    assert "EqualTo(order_status,delivered)" in scan and "IsNotNull(order_delivered_customer_date)" in scan


def test_questions_drop_dimension_joins_they_do_not_read(spark):
    fact = Model(spark, SF001).fact
    q1 = questions.stage_by_outcome(fact)._jdf.queryExecution().optimizedPlan().toString()
    q7 = questions.lateness_bands(fact)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in q1  # stage hours need the orders alone
    assert q7.count("Join ") == 1  # orders and the latest review only
