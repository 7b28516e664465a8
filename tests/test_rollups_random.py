"""Order rollups against a brute-force Python reading of their definitions,
on random tables full of ties and NULLs."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from lateflow.operators import facts
from lateflow.sources.schemas import ORDER_ITEMS, ORDER_REVIEWS


def _desc_key(values):
    # DESC with NULLs last == max with NULL lowest, field by field
    return tuple((v is not None, v) for v in values)


def _random_items(rnd: random.Random, n: int):
    base = dt.datetime(2018, 1, 1)
    rows = []
    for _ in range(n):
        order = f"o{rnd.randint(0, 40)}"
        limit = None if rnd.random() < 0.1 else base + dt.timedelta(days=rnd.randint(0, 3))
        item = None if rnd.random() < 0.05 else rnd.randint(1, 3)
        seller = None if rnd.random() < 0.05 else f"s{rnd.randint(0, 4)}"
        product = None if rnd.random() < 0.05 else f"p{rnd.randint(0, 6)}"
        price = Decimal(rnd.randint(0, 99999)) / 100
        freight = Decimal(rnd.randint(0, 9999)) / 100
        rows.append((order, item, product, seller, limit, price, freight))
    return rows


def test_binding_and_composition_match_brute_force(spark):
    rnd = random.Random(5)
    rows = _random_items(rnd, 400)
    df = spark.createDataFrame(rows, ORDER_ITEMS)
    got_b = {r["order_id"]: (r["seller_id"], r["shipping_limit_date"]) for r in facts.binding_seller(df).collect()}
    got_c = {r["order_id"]: tuple(r)[1:] for r in facts.order_composition(df).collect()}
    by_order: dict[str, list] = {}
    for r in rows:
        by_order.setdefault(r[0], []).append(r)
    for order, rs in by_order.items():
        top = max(rs, key=lambda r: _desc_key((r[4], r[1], r[3], r[2])))
        assert got_b[order] == (top[3], top[4]), order
        want = (
            len(rs),
            len({r[3] for r in rs if r[3] is not None}),
            len({r[2] for r in rs if r[2] is not None}),
            sum(r[5] for r in rs),
            sum(r[6] for r in rs),
        )
        assert got_c[order] == want, order


def test_latest_review_matches_brute_force(spark):
    rnd = random.Random(9)
    base = dt.datetime(2018, 1, 1)
    rows = []
    for i in range(300):
        order = None if rnd.random() < 0.05 else f"o{rnd.randint(0, 50)}"
        created = None if rnd.random() < 0.1 else base + dt.timedelta(hours=rnd.randint(0, 5))
        rows.append((f"r{i:04d}", order, rnd.randint(1, 5), None, None, created, None))
    df = spark.createDataFrame(rows, ORDER_REVIEWS)
    latest = {r["order_id"]: r["review_score"] for r in facts.latest_review(df).collect()}
    best = {r["order_id"]: r["review_score"] for r in facts.latest_review(df, "max").collect()}
    by_order: dict[str, list] = {}
    for r in rows:
        if r[1] is not None:
            by_order.setdefault(r[1], []).append(r)
    assert set(latest) == set(by_order) == set(best)
    for order, rs in by_order.items():
        top = max(rs, key=lambda r: _desc_key((r[5], r[0], r[2])))
        assert latest[order] == top[2], order
        assert best[order] == max(r[2] for r in rs), order
