"""Stored layouts: raw tables by order, the Z-ordered fact; and comparisons of whole results."""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lateflow.operators import facts, pareto, quality, questions
from lateflow.plans import layout, materialize
from lateflow.plans.registry import Model
from lateflow.sources import versions

from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def raw(spark):
    return Model(spark, SF001).raw


def store(spark, raw, tmp_path, **options):
    return layout.store_by_order(spark, raw, str(tmp_path), database=f"by_order_{uuid.uuid4().hex[:8]}", **options)


def test_no_exchange_on_the_order(spark, raw, tmp_path):
    stored = store(spark, raw, tmp_path, buckets=4)
    p = plan(layout._fact(stored.cold, True))
    assert "Bucketed: true" in p and "hashpartitioning(order_id" not in p
    lines = facts.fact_lines(stored.cold.order_items, layout._fact(stored.cold, True), raw.products, raw.product_category_translation)
    assert "hashpartitioning(order_id" not in plan(lines)
    assert "hashpartitioning(order_id" in plan(facts.fact_orders_from(raw))  # what the layout saves
    assert rows(layout.fact_orders_by_order(stored)) == rows(facts.fact_orders_from(raw))
    again = layout.open_by_order(spark, raw, str(tmp_path), database=f"by_order_{uuid.uuid4().hex[:8]}")
    assert again.buckets == 4 and again.cold.orders.count() == stored.cold.orders.count()


def test_hot_order_and_rows_without_order_spread(spark, raw, tmp_path):
    """A third of all lines in one order, and many reviews without one: no bucket holds them."""
    one = raw.order_items.agg(F.min("order_id")).first()[0]
    n = raw.order_items.count() // 2
    many = spark.range(n).select(F.lit(one).alias("order_id"), F.col("id").cast("int").alias("order_item_id")).join(
        raw.order_items.drop("order_id", "order_item_id").limit(1), how="cross"
    )
    items = raw.order_items.unionByName(many.select(*raw.order_items.columns))
    reviews = raw.order_reviews.withColumn("order_id", F.when(F.col("review_id") % 3 != 0, F.col("order_id")))
    hot = replace(raw, order_items=items, order_reviews=reviews)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        stored = store(spark, hot, tmp_path, buckets=4, hot_rows=50)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert stored.cold.order_items.where(F.col("order_id") == one).count() == 0
    assert stored.hot.order_reviews.where("order_id is null").count() > 0
    per_file = [r["n"] for r in stored.hot.order_items.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_file) > n and max(per_file) < sum(per_file) / 2
    assert rows(layout.fact_orders_by_order(stored)) == rows(facts.fact_orders_from(hot, reduce_sides=False))
    assert rows(layout.fact_lines_by_order(stored)) == rows(facts.fact_lines_from(hot))


def test_seller_filter_reads_few_row_groups(spark, raw, tmp_path):
    """Of the row groups of a stored fact, those whose box of days and sellers may hold one seller: less than a third; all rows are still found."""
    many = raw.orders.crossJoin(spark.range(40)).withColumn("order_id", F.col("order_id") * 1000 + F.col("id")).drop("id")
    items = raw.order_items.crossJoin(spark.range(40)).withColumn("order_id", F.col("order_id") * 1000 + F.col("id")).drop("id")
    big = replace(raw, orders=many, order_items=items)
    path = str(tmp_path / "fact")
    materialize.build_fact_orders(big, path, by_month=True, row_group_bytes=16_000)
    at = versions.current(spark, path)
    stored = spark.read.parquet(at)
    assert rows(stored.select("order_id", "seller_id")) == rows(facts.fact_orders_from(big).select("order_id", "seller_id"))
    seller = stored.where("seller_id is not null").groupBy("seller_id").count().orderBy("count").first()["seller_id"]
    groups = hit = 0
    for file in glob.glob(f"{at}/purchase_month=*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index("seller_id")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            groups += 1
            hit += stats is not None and stats.has_min_max and stats.min <= seller <= stats.max
    assert groups > 100 and hit < groups / 3, (hit, groups)
    scan = stored.where(F.col("seller_id") == seller)
    assert f"EqualTo(seller_id,{seller})" in plan(scan) and scan.count() == stored.where(F.col("seller_id").cast("string") == str(seller)).count()


def test_zorder_and_ranks(spark):
    x = spark.range(64).crossJoin(spark.range(64).withColumnRenamed("id", "b"))
    z = x.select(materialize.zorder(F.col("id"), F.col("b")).alias("z"))
    assert z.distinct().count() == 4096 and z.agg(F.max("z")).first()[0] == 4095
    bounds = materialize.rank_bounds(spark.range(1000).select(F.col("id").cast("string").alias("s")), "s", 8)
    assert bounds == sorted(bounds) and 5 <= len(bounds) <= 8
    assert materialize.rank_bounds(spark.range(0).select(F.col("id").alias("s")), "s") == []


def test_dominance_flags_one_seller_of_ten(spark):
    fact = [("A", 1, 1)] * 95 + [("A", k, 0) for k in range(2, 11)] + [("B", k % 10, 0) for k in range(100)] + [(None, 1, 1), ("C", None, 1)]
    df = spark.createDataFrame(fact, "seller_state string, seller_id int, is_late int")
    got = {r["seller_state"]: r for r in questions.dominance(df).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["entities"], got["A"]["top_entity"], got["A"]["top_orders"], got["A"]["dominated"]) == (10, 1, 95, True)
    assert float(got["A"]["top_share_pct"]) == 91.35 and float(got["A"]["herfindahl"]) == 0.8352
    assert (got["B"]["top_entity"], got["B"]["dominated"], float(got["B"]["herfindahl"])) == (9, False, 0.1)
    late = questions.dominance(df, weight="is_late").collect()
    assert [(r["seller_state"], r["orders"], r["entities"], float(r["top_share_pct"])) for r in late] == [("A", 95, 1, 100.0)]


def reconcile_brute(a, b) -> list:
    """``a``, ``b``: dicts of key -> values."""
    out = [(*k, "only a", None, None, None) for k in a if k not in b] + [(*k, "only b", None, None, None) for k in b if k not in a]
    text = lambda v: None if v is None else str(v)
    for k in a.keys() & b.keys():
        out += [(*k, "differs", c, text(x), text(y)) for c, x, y in zip("vw", a[k], b[k]) if x != y]
    return sorted(out, key=str)


def test_reconcile(spark):
    import random

    r = random.Random(3)
    a = {(k, r.choice([None, "x"])): (r.choice([None, 1, 2]), r.choice([None, 1, 2])) for k in [None, *range(300)]}
    b = {k: v for k, v in a.items() if k[0] is None or k[0] % 50}
    b |= {(900, None): (1, 1), (0, "z"): (None, None)}
    for k in list(b)[::40]:
        b[k] = (b[k][1], b[k][0])  # values that slid into the next column
    df = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], "k long, t string, v int, w int").repartition(3)
    for buckets in (1, 7, 4096):
        out = quality.reconcile(df(a), df(b).select("w", "v", "t", "k"), ["k", "t"], buckets=buckets)
        assert out.columns == ["k", "t", "status", "column_name", "value_a", "value_b"]
        assert sorted(map(tuple, out.collect()), key=str) == reconcile_brute(a, b)
    assert quality.reconcile(df(a), df(a), ["k", "t"]).count() == 0
    assert quality.differing_buckets(df(a), df(b), ["k", "t"], ["k", "t", "v", "w"], 4096).count() < 40
    twice = df(a).unionByName(df(a).limit(1))
    assert [x["status"] for x in quality.reconcile(twice, df(a), ["k", "t"]).collect()] == ["only a"]
    with pytest.raises(ValueError):
        quality.reconcile(df(a), df(a).drop("v"), ["k"])


def test_full_curve_is_lazy_and_exact(spark):
    """Ranks of all sellers from prefix sums over late counts and cells, equal to a window over everything; nothing runs while the plan is built."""
    from pyspark.sql import Window

    data = [(f"{(i * 7919) % 997:03d}{i}", None if i % 9 == 0 else "st", 40, 0 if i % 3 else (i * 31) % 11) for i in range(3000)]
    for df in (spark.createDataFrame(data, "seller_id string, seller_state string, orders long, late_orders long"),
               spark.createDataFrame([(int(a), *x) for a, *x in data], "seller_id long, seller_state string, orders long, late_orders long")):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        ranked = pareto.ranks_by_value(df, "late_orders", ["seller_id", "seller_state"])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)
        assert "Scan ExistingRDD" not in plan(ranked) or "checkpoint" not in plan(ranked).lower()
        order = Window.orderBy(F.desc("late_orders"), F.asc("seller_id"), F.asc_nulls_first("seller_state"))
        want = df.select("*", F.row_number().over(order).cast("long").alias("_rank"), F.sum("late_orders").over(order).alias("_cum"))
        assert sorted(ranked.select("seller_id", "_rank", "_cum").coalesce(2).collect()) == sorted(want.select("seller_id", "_rank", "_cum").collect())
        assert {(r["_rows"], r["_total"]) for r in ranked.collect()} == {(3000, sum(x[3] for x in data))}
