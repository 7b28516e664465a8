"""Scalar semantics: boundary-counted differences, flags, lanes, bands, exact rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from lateflow.functions import exact
from lateflow.functions.expr import (
    BAND_LABELS,
    band_labels,
    days_between,
    lateness_band,
    minutes_between,
    shipping_lane,
    weekday_name,
)

from conftest import ts


def _one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()["x"]


def test_minute_difference_counts_boundaries(spark):
    schema = "a timestamp_ntz, b timestamp_ntz"
    m = minutes_between("a", "b")
    assert _one(spark, m, schema, (ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:00"))) == 1
    assert _one(spark, m, schema, (ts("2024-01-01 10:00:00"), ts("2024-01-01 10:00:59"))) == 0
    assert _one(spark, m, schema, (ts("2024-01-01 10:05:00"), ts("2024-01-01 10:00:30"))) == -5
    assert _one(spark, m, schema, (None, ts("2024-01-01 10:00:30"))) is None


def test_minutes_do_not_depend_on_the_session_zone(spark):
    rows = [(ts("2018-03-11 02:30:00"), ts("2018-03-11 04:00:00")), (ts("2018-11-04 00:59:59"), ts("2018-11-04 02:00:00")),
            (ts("1965-06-01 00:00:59"), ts("1965-06-01 00:01:00"))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz").select(minutes_between("a", "b"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.collect()] == [90, 61, 1], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_difference_counts_calendar_days(spark):
    schema = "a timestamp_ntz, b timestamp_ntz"
    d = days_between("a", "b")
    assert _one(spark, d, schema, (ts("2024-01-01 23:59:00"), ts("2024-01-02 00:01:00"))) == 1
    assert _one(spark, d, schema, (ts("2024-01-03 00:00:00"), ts("2024-01-01 23:00:00"))) == -2


def test_weekday_is_full_english_name(spark):
    assert _one(spark, weekday_name("a"), "a timestamp_ntz", (ts("2024-01-03 12:00:00"),)) == "Wednesday"


def test_lane_null_state_is_inter_state(spark):
    schema = "s string, c string"
    lane = shipping_lane("s", "c")
    assert _one(spark, lane, schema, ("SP", "SP")) == "Intra-state"
    assert _one(spark, lane, schema, ("SP", "RJ")) == "Inter-state"
    assert _one(spark, lane, schema, (None, "SP")) == "Inter-state"
    assert _one(spark, lane, schema, (None, None)) == "Inter-state"


def test_lateness_bands_edges(spark):
    rows = [(0, -3), (1, 0), (1, 1), (1, 3), (1, 4), (1, 7), (1, 8), (1, 14), (1, 15), (0, 0)]
    df = spark.createDataFrame(rows, "is_late int, days_late int")
    got = [r[0] for r in df.select(lateness_band()).collect()]
    b = BAND_LABELS
    assert got == [b[0], b[1], b[2], b[2], b[3], b[3], b[4], b[4], b[5], b[0]]


def test_buggy_bands_sweep_same_day_into_last_band(spark):
    df = spark.createDataFrame([(1, 0)], "is_late int, days_late int")
    assert df.select(lateness_band(same_day_band=False)).first()[0] == BAND_LABELS[5]


def test_custom_band_labels_follow_the_rule():
    assert band_labels((0, 3, 7, 14)) == list(BAND_LABELS)
    assert band_labels((0, 2, 30))[2:] == ["2 - 1 to 2 days late", "3 - 3 to 30 days late", "4 - 31+ days late"]


def test_exact_percent_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 5), (5, 0), (1, 200)], "x long, n long")
    got = [r[0] for r in df.select(exact.pct("x", "n")).collect()]
    assert got == [Decimal("12.50"), Decimal("33.33"), Decimal("66.67"), Decimal("0.00"), None, Decimal("0.50")]


def test_exact_mean_hours_negative_and_ties(spark):
    # -90 minutes over 1 row = -1.5 h -> -1.5; -3 minutes over 1 row = -0.05 h -> -0.1
    df = spark.createDataFrame([(-90, 1), (-3, 1), (3, 1), (100, 3)], "m long, n long")
    got = [r[0] for r in df.select(exact.mean_hours("m", "n")).collect()]
    assert got == [Decimal("-1.5"), Decimal("-0.1"), Decimal("0.1"), Decimal("0.6")]


def test_exact_matches_python_decimal_rounding(spark):
    import random

    from decimal import ROUND_HALF_UP

    rnd = random.Random(7)
    pairs = [(rnd.randint(-10_000, 10_000), rnd.randint(1, 5_000)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(exact.round_ratio("a", "b", 2, 18)).collect()]
    want = [(Decimal(a) / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for a, b in pairs]
    assert got == want


def test_scaled_rate_is_bigint(spark):
    df = spark.createDataFrame([(1, 3)], "x long, n long")
    row = df.select(exact.rate_scaled("x", "n").alias("r")).first()
    assert row["r"] == 33_333_333_333_333
    assert dict(df.select(exact.rate_scaled("x", "n").alias("r")).dtypes)["r"] == "bigint"


def test_strip_text_uses_python_whitespace(spark):
    from lateflow.functions.expr import strip_text

    s = "   x 　\x1c"
    assert _one(spark, strip_text(F.col("v")), "v string", (s,)) == s.strip()


def test_lateness_band_matches_python_reference(spark):
    import random

    def ref(is_late, days):
        if is_late == 0:
            return BAND_LABELS[0]
        if days == 0:
            return BAND_LABELS[1]
        for label, lo, hi in ((BAND_LABELS[2], 1, 3), (BAND_LABELS[3], 4, 7), (BAND_LABELS[4], 8, 14)):
            if days is not None and lo <= days <= hi:
                return label
        return BAND_LABELS[5]

    rnd = random.Random(11)
    rows = [(rnd.choice([0, 1]), rnd.choice([None] + list(range(-20, 40)))) for _ in range(500)]
    df = spark.createDataFrame(rows, "is_late int, days_late int")
    got = [r[0] for r in df.select(lateness_band()).collect()]
    assert got == [ref(a, b) for a, b in rows]


def test_minute_and_day_boundaries_match_python_on_random_stamps(spark):
    import datetime as dt
    import math
    import random

    rnd = random.Random(3)
    epoch = dt.datetime(1970, 1, 1)

    def rand_ts():
        return dt.datetime(1965, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 2_000_000_000), microseconds=rnd.randint(0, 999_999))

    def minutes(t):
        return math.floor((t - epoch).total_seconds() // 60)

    rows = [(rand_ts(), rand_ts()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = df.select(minutes_between("a", "b").alias("m"), days_between("a", "b").alias("d")).collect()
    for (a, b), r in zip(rows, got):
        assert r["m"] == minutes(b) - minutes(a), (a, b)
        assert r["d"] == (b.date() - a.date()).days, (a, b)
