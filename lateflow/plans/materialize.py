"""Materialise the raw layer and the two facts (I9, I13, I14, I16) as parquet
in a shared folder, the way the reference loads raw tables and then builds
its facts with SELECT INTO.

Raw tables are written with a REBALANCE hint on their key: AQE sizes the
output partitions (splitting a hot key, merging small ones), so later scans
run in parallel whatever the layout of the source files was. ``layout`` has the
form of the raw layer that the fact build reads without shuffles on the order.

Fact layout: rows are rebalanced by month (AQE splits a hot month, merges
small ones) and written under ``purchase_month=`` directories, so date filters
prune whole months. Inside a month rows follow a Z-order of the date and the
seller's rank (``zorder``): row groups are small boxes of days and sellers, so
parquet min/max statistics prune by either. Bloom filters on order and seller
ids prune what the statistics cannot.

Every table is published as a new version (``sources.versions``): readers switch when it is complete, and
a build that fails leaves the version before.

Reading the written table back cuts the lineage: questions run over stored
facts, and a lost executor costs a re-read, not a rebuild from raw.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.operators.facts import fact_lines, fact_orders_from
from lateflow.sources import versions
from lateflow.sources.schemas import RawModel


# Upper bound on rows per output file, whatever the partition count.
MAX_RECORDS_PER_FILE = 5_000_000


# Row groups are small enough for a filter to skip most of them.
ROW_GROUP_BYTES = 16 * 1024 * 1024
SELLER_RANKS = 64


def rank_bounds(ids: DataFrame, column: str, ranks: int = SELLER_RANKS) -> list:
    """Least id of each of at most ``ranks`` ranges of about equal counts of distinct ids, in order."""
    own = ids.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = own.repartitionByRange(ranks, column).groupBy(F.spark_partition_id()).agg(F.min(column).alias("least"))
    return sorted(r["least"] for r in ranged.collect())[1:]


def zorder(day: Column, rank: Column, bits: int = 6) -> Column:
    """Bits of the two numbers interleaved: near rows are near in both."""
    out = F.lit(0)
    for b in range(bits):
        for k, n in enumerate((day, rank)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(n.cast("int"), b).bitwiseAND(F.lit(1)), 2 * b + k))
    return out


def layout_key(bounds: list, seller: str = "seller_id", date: str = "purchase_date") -> Column:
    """Place of a row in its month: Z-order of the day and the seller's rank among ``bounds``."""
    rank = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(seller))) if bounds else F.lit(0)
    return zorder(F.dayofmonth(date), F.when(F.col(seller).isNull(), 0).otherwise(rank))


def write_dated(df: DataFrame, path: str, by_month: bool = True, bounds: list | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Lay rows out by date and, given the ranks' ``bounds``, by seller, and publish them as parquet.

    A REBALANCE on the month (or, without month folders, the date) gathers
    each period's rows; AQE splits a hot period into advisory-size pieces
    and merges small ones -- no sampling pass over the facts, no fixed partition count.
    Rows are sorted inside each file (parquet min/max statistics then
    prune row groups) and files are capped at ``MAX_RECORDS_PER_FILE`` rows.
    """
    monthly = by_month and "purchase_month" in df.columns
    key = "purchase_month" if monthly else "purchase_date"
    order = [key, layout_key(bounds), "seller_id", "purchase_date"] if monthly and bounds is not None else [key, "purchase_date"]
    laid = df.hint("rebalance", key).sortWithinPartitions(*order)
    writer = laid.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).option("parquet.block.size", row_group_bytes)
    for column in ("order_id", "seller_id"):
        if column in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", 128 * 1024)
    if monthly:
        writer = writer.partitionBy("purchase_month")
    versions.publish(df.sparkSession, path, writer.parquet)


# Key of each raw table (the reference's primary keys; items and reviews
# follow their order).
RAW_KEYS = {
    "orders": "order_id",
    "order_items": "order_id",
    "order_reviews": "order_id",
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "product_category_translation": "product_category_name",
    "order_payments": "order_id",
    "geolocation": "geolocation_zip_code_prefix",
}


def store_raw(spark: SparkSession, raw: RawModel, root: str, parallel: int = 4) -> RawModel:
    """Publish every table of ``raw`` under ``root`` and return the
    stored tables as a new ``RawModel``.

    The tables are independent jobs, submitted from ``parallel`` driver
    threads so small tables do not wait behind big ones; Spark schedules
    their tasks side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    def write(item):
        name, df = item
        laid = df.hint("rebalance", RAW_KEYS[name]).write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        return name, versions.publish(spark, f"{root.rstrip('/')}/{name}", laid.parquet)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        paths = dict(pool.map(write, raw.tables().items()))
    return RawModel(**{name: spark.read.parquet(path) for name, path in paths.items()})


@dataclass(frozen=True)
class Facts:
    orders_path: str
    lines_path: str

    def orders(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(versions.current(spark, self.orders_path))

    def lines(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(versions.current(spark, self.lines_path))


def build_fact_orders(raw: RawModel, path: str, **layout) -> None:
    bounds = rank_bounds(raw.sellers, "seller_id")
    write_dated(fact_orders_from(raw, reduce_sides=False), path, bounds=bounds, **layout)


def build_fact_lines(spark: SparkSession, raw: RawModel, orders_path: str, path: str) -> None:
    fact = spark.read.parquet(versions.current(spark, orders_path))
    lines = fact_lines(raw.order_items, fact, raw.products, raw.product_category_translation)
    write_dated(lines, path, by_month=False)


def build_facts(spark: SparkSession, raw: RawModel, root: str) -> Facts:
    """Build and store both facts under ``root``; return their locations."""
    facts = Facts(f"{root.rstrip('/')}/fact_order_fulfillment", f"{root.rstrip('/')}/fact_order_lines")
    build_fact_orders(raw, facts.orders_path)
    build_fact_lines(spark, raw, facts.orders_path, facts.lines_path)
    return facts
