"""Every registered job against its DuckDB oracle at sf0.01 (the driver's gate)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF01
from lateflow.plans.registry import JOBS
from oracle_harness import compare, duck

NAMES = list(JOBS)  # training-data queries have tests of their own
# No month of the small tables reaches the default gate of 100 orders; the
# jobs with a gate of 50 prove the same operators.
EMPTY = {"q4_trend", "spike_months"}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", NAMES)
def test_job_matches_oracle(spark, con, name):
    r = compare(spark, SF01, name, con)
    assert r["status"] in ("match", "no-oracle"), r
    assert r["spark_rows"] > 0 or name in EMPTY, r


def test_every_oracle_has_a_job():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == [
        "shipping_lane",
        "missed_ship_sla",
        "orders",
        "late_orders",
        "late_rate_pct",
        "avg_hrs_handling",
        "avg_hrs_transit",
    ]
