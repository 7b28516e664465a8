"""The raw layer laid out by order, for fact builds that do not shuffle on the order (2.10).

Orders, items and reviews are stored as tables bucketed and sorted by ``order_id`` with one
number of buckets, so rollups by order and the joins of orders, items and reviews run
bucket by bucket without an Exchange on ``order_id``.

A bucket is read by one task, so an order with very many rows would pin its bucket. Orders with more than
``hot_rows`` items or reviews (there are at most rows / hot_rows of them), and rows without an order, are stored apart, spread evenly
over files whatever their key. The fact of those orders is built the usual way, with
partial aggregation before each shuffle, and the two facts are put together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.operators.facts import fact_lines, fact_orders
from lateflow.session import checkpoint_root
from lateflow.sources import versions
from lateflow.sources.schemas import RawModel

BY_ORDER = ("orders", "order_items", "order_reviews")
KEY = "order_id"
BUCKET_ROWS = 500_000  # a task reads one bucket, so this bounds its memory
HOT_ROWS = 500_000


@dataclass(frozen=True)
class OrderLayout:
    """The raw model in two parts: ``cold``, bucketed by order, and ``hot``."""

    cold: RawModel
    hot: RawModel
    buckets: int


def hot_orders(tables: list[DataFrame], hot_rows: int) -> DataFrame:
    """Orders with more than ``hot_rows`` rows in one of the tables."""
    many = [t.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > hot_rows) & F.col(KEY).isNotNull()).select(KEY) for t in tables]
    return reduce(DataFrame.unionByName, many).distinct()


def store_by_order(spark: SparkSession, raw: RawModel, root: str, buckets: int | None = None, hot_rows: int = HOT_ROWS, database: str = "by_order") -> OrderLayout:
    """Publish orders, items and reviews of ``raw`` under ``root`` by order: one bucket for each ``BUCKET_ROWS`` items, ``buckets`` at least."""
    checkpoint_root(spark)
    hot = hot_orders([raw.order_items, raw.order_reviews], hot_rows).checkpoint(eager=True)
    n = max(buckets or 1, -(-raw.order_items.count() // BUCKET_ROWS))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root.rstrip('/')}'")
    for table in BY_ORDER:
        df = raw.tables()[table]
        cold = df.where(F.col(KEY).isNotNull()).join(hot, KEY, "left_anti")
        apart = df.join(hot, KEY, "left_semi").unionByName(df.where(F.col(KEY).isNull()))

        def write(at: str, cold=cold, apart=apart) -> None:
            name = f"{database}.writing_{at.rsplit('-', 1)[1]}"
            # dealt out as the buckets are, so each bucket is one file
            laid = cold.repartition(n, KEY).sortWithinPartitions(KEY)
            laid.write.bucketBy(n, KEY).sortBy(KEY).option("path", f"{at}/cold_{n}").saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")  # external: the files stay
            apart.hint("rebalance").write.parquet(f"{at}/hot")

        versions.publish(spark, f"{root.rstrip('/')}/{table}", write)
    return open_by_order(spark, raw, root, database)


def open_by_order(spark: SparkSession, raw: RawModel, root: str, database: str = "by_order") -> OrderLayout:
    """The stored layout, registered in the session's catalog (bucketing is known to the catalog only); other tables are those of ``raw``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root.rstrip('/')}'")
    cold, hot, n = {}, {}, 1
    for table in BY_ORDER:
        at = versions.current(spark, f"{root.rstrip('/')}/{table}")
        n = next(int(x.removeprefix("cold_")) for x in versions.names(spark, at) if x.startswith("cold_"))
        hot[table] = spark.read.parquet(f"{at}/hot")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot[table].schema.fields)
        name = f"{database}.{table}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {n} BUCKETS LOCATION '{at}/cold_{n}'")
        cold[table] = spark.table(name)
    return OrderLayout(replace(raw, **cold), replace(raw, **hot), n)


def _fact(raw: RawModel, sides_last: bool) -> DataFrame:
    return fact_orders(raw.orders, raw.order_items, raw.order_reviews, raw.sellers, raw.customers, reduce_sides=False, sides_last=sides_last)


def fact_orders_by_order(stored: OrderLayout) -> DataFrame:
    """F7 from the layout: no Exchange on the order for bucketed orders."""
    return _fact(stored.cold, True).unionByName(_fact(stored.hot, False))


def fact_lines_by_order(stored: OrderLayout) -> DataFrame:
    """F8 from the layout, with the order fact planned in the same buckets."""

    def lines(raw: RawModel, sides_last: bool) -> DataFrame:
        return fact_lines(raw.order_items, _fact(raw, sides_last), raw.products, raw.product_category_translation)

    return lines(stored.cold, True).unionByName(lines(stored.hot, False))
