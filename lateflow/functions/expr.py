"""Scalar column expressions of the fulfillment model (all JVM-side, codegen'd).

Each helper maps one clause of the reference's SQL onto built-in functions:

* ``minutes_between``  -- DATEDIFF(minute, a, b): counts minute *boundaries*
  crossed (10:00:59 -> 10:01:00 is 1), so both ends are floored to the minute.
* ``days_between``     -- DATEDIFF(day, a, b): calendar-day boundaries, signed.
* ``flag``             -- CASE WHEN <pred> THEN 1 ELSE 0 END: an unknown
  predicate (NULL operand) yields 0, not NULL.
* ``shipping_lane``    -- NULL states compare unequal, so they land in
  'Inter-state'.
* ``lateness_band``    -- ordered CASE; the is_late test precedes the
  days_late tests so an order hours late on the promised day gets its own band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch() -> Column:
    """The zone-free origin that stamps are counted from; before any stamp in use, so counts are not negative."""
    return F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'")


def _whole_minutes(ts: Column | str) -> Column:
    # NTZ minus NTZ is an interval without any zone; as BIGINT it is whole seconds
    seconds = (_c(ts).cast("timestamp_ntz") - epoch()).cast("bigint")
    return F.call_function("div", seconds, F.lit(60).cast("bigint"))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Signed count of minute boundaries from start to end (BIGINT); NULL if either is NULL.

    Counted on the stamps as written, so the session's zone plays no part."""
    return _whole_minutes(end) - _whole_minutes(start)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Signed count of calendar-day boundaries from start to end (INT)."""
    return F.datediff(_c(end), _c(start))


def hours(minutes: Column | str) -> Column:
    """Minutes as DOUBLE hours (one correctly rounded division)."""
    return _c(minutes).cast("double") / F.lit(60.0)


def flag(predicate: Column) -> Column:
    """CASE WHEN predicate THEN 1 ELSE 0 END -- NULL counts as false."""
    return F.when(predicate, F.lit(1)).otherwise(F.lit(0))


def month_start(ts: Column | str) -> Column:
    """DATEFROMPARTS(YEAR(ts), MONTH(ts), 1) as DATE."""
    return F.trunc(F.to_date(_c(ts)), "MM")


def weekday_name(ts: Column | str) -> Column:
    """DATENAME(weekday, ts): full English day name ('Wednesday')."""
    return F.date_format(_c(ts), "EEEE")


def shipping_lane(seller_state: Column | str, customer_state: Column | str) -> Column:
    """'Intra-state' when both states are known and equal, else 'Inter-state'."""
    return F.when(_c(seller_state) == _c(customer_state), F.lit("Intra-state")).otherwise(
        F.lit("Inter-state")
    )


# The band labels of the lateness-vs-review question, for the
# default day edges (0, 3, 7, 14). They must equal the reference's output text.
BAND_LABELS = (
    "0 - On time or early",
    "1 - Same day, hours late",
    "2 - 1 to 3 days late",
    "3 - 4 to 7 days late",
    "4 - 8 to 14 days late",
    "5 - 15+ days late",
)
DEFAULT_BAND_EDGES = (0, 3, 7, 14)


def band_labels(edges: Sequence[int] = DEFAULT_BAND_EDGES) -> list[str]:
    """Labels for day edges; the default edges give ``BAND_LABELS``."""
    edges = tuple(edges)
    if edges == DEFAULT_BAND_EDGES:
        return list(BAND_LABELS)
    labels = list(BAND_LABELS[:2])
    for i in range(1, len(edges)):
        labels.append(f"{i + 1} - {edges[i - 1] + 1} to {edges[i]} days late")
    labels.append(f"{len(edges) + 1} - {edges[-1] + 1}+ days late")
    return labels


def lateness_band(
    is_late: Column | str = "is_late",
    days_late: Column | str = "days_late",
    edges: Sequence[int] = DEFAULT_BAND_EDGES,
    same_day_band: bool = True,
) -> Column:
    """The ordered CASE of the lateness question.

    ``edges[0]`` is the same-day value (0); each later edge closes a band
    ``BETWEEN previous+1 AND edge``. ``same_day_band=False`` drops the
    same-day branch, which reproduces the catch-all ELSE defect (hours-late
    orders fall into the last band) for reconciliation checks.
    """
    labels = band_labels(edges)
    il, dl = _c(is_late), _c(days_late)
    expr = F.when(il == 0, F.lit(labels[0]))
    if same_day_band:
        expr = expr.when(dl == edges[0], F.lit(labels[1]))
    for i in range(1, len(edges)):
        expr = expr.when(dl.between(edges[i - 1] + 1, edges[i]), F.lit(labels[i + 1]))
    return expr.otherwise(F.lit(labels[-1]))


# The characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(c: Column | str) -> Column:
    """Python ``str.strip()`` semantics (Spark ``trim`` removes spaces only)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))
