"""Map the driver's TPC-H-like parquet tables onto the raw order model.

The reference reads nine marketplace CSVs that are not available offline. Its
raw model (orders with five stage stamps, items with a shipping limit,
reviews, customers, sellers, products, category translation) is derived here
from ``orders``, ``lineitem``, ``events``, ``customer``, ``supplier``,
``nation``, ``region`` and ``part`` by integer arithmetic that any SQL engine
evaluates identically (the rules are listed in FIXTURES.md section 3).

Everything is a lazy projection except two joins: items need their order's
purchase stamp (shuffle on the order key, which the fact build then reuses),
and customers/suppliers take nation and region names (25 and 5 rows, a fixed
size, so those two are broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.sources.schemas import RawModel

# Items of one partition by order; a task's sort and rollups take about 500 bytes each.
PARTITION_ITEMS = 250_000

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _add_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def derive_orders(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    u = (k * 101 + c * 17) % 1000
    approved = _add_minutes(F.col("o_orderdate"), (k * 37) % 2880)
    carrier = _add_minutes(approved, (k * 53 + c * 11) % 7200)
    delivered = _add_minutes(carrier, F.call_function("div", u * u * u, F.lit(20000)))
    status = F.col("o_orderstatus")
    return orders.select(
        k.alias("order_id"),
        c.alias("customer_id"),
        F.when(status == "F", "delivered")
        .when(status == "O", "shipped")
        .when(status == "P", "processing")
        .alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(k % 97 == 0, F.lit(None)).otherwise(approved).alias("order_approved_at"),
        carrier.alias("order_delivered_carrier_date"),
        F.when(k % 89 == 0, F.lit(None)).otherwise(delivered).alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(18), F.col("o_orderdate")).alias("order_estimated_delivery_date"),
    )


def item_partitions(lineitem: DataFrame) -> int:
    """Partitions for joins and rollups of all items by order: one for each ``PARTITION_ITEMS`` items, whatever the session's number is.

    AQE joins small partitions until there is one per core, so a task would hold more items the more there are."""
    return max(1, -(-lineitem.count() // PARTITION_ITEMS))  # footers only


def derive_order_items(lineitem: DataFrame, orders: DataFrame, partitions: int | None = None) -> DataFrame:
    # one row per order key, so that a job which does not read the shipping
    # limit drops this left join. The number of partitions is set on this side: the items
    # follow it, and it goes where the join goes
    dealt = orders.repartition(partitions or item_partitions(lineitem), "o_orderkey")
    purchase = dealt.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.max("o_orderdate").alias("_purchase"))
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return lineitem.join(purchase, "l_orderkey", "left").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.timestamp_add("DAY", (F.col("l_partkey") % 4 + 3).cast("int"), F.col("_purchase")).alias(
            "shipping_limit_date"
        ),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)").alias("freight_value"),
    )


def derive_order_reviews(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        eid.alias("review_id"),
        F.when(eid % 10 == 9, eid - 1).otherwise(eid).alias("order_id"),
        (F.floor("value").cast("int") % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.col("ts").alias("review_answer_timestamp"),
    )


def _geo(nation: DataFrame, region: DataFrame) -> DataFrame:
    # nation (25 rows) and region (5 rows) have a fixed size at every scale.
    return nation.join(
        F.broadcast(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")),
        "n_regionkey",
        "left",
    ).select("n_nationkey", "n_name", "r_name")


def derive_customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    geo = _geo(nation, region).withColumnRenamed("n_nationkey", "c_nationkey")
    return customer.join(F.broadcast(geo), "c_nationkey", "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.lit(None).cast("string").alias("customer_zip_code_prefix"),
        F.col("n_name").alias("customer_city"),
        F.col("r_name").alias("customer_state"),
    )


def derive_sellers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    geo = _geo(nation, region).withColumnRenamed("n_nationkey", "s_nationkey")
    return supplier.join(F.broadcast(geo), "s_nationkey", "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.lit(None).cast("string").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_city"),
        F.col("r_name").alias("seller_state"),
    )


def derive_products(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 50 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias(
            "product_category_name"
        ),
        F.length("p_name").cast("int").alias("product_name_lenght"),
        F.lit(None).cast("int").alias("product_description_lenght"),
        F.lit(None).cast("int").alias("product_photos_qty"),
        (size * 100).cast("double").alias("product_weight_g"),
        size.cast("double").alias("product_length_cm"),
        (size % 10 + 1).cast("double").alias("product_height_cm"),
        (size % 7 + 1).cast("double").alias("product_width_cm"),
    )


def derive_translation(part: DataFrame) -> DataFrame:
    brand = F.col("p_brand")
    return (
        part.select(brand)
        .filter(brand.isNotNull() & ~brand.endswith("5"))
        .distinct()
        .select(
            brand.alias("product_category_name"),
            F.concat(F.lit("Category "), F.expr("substring(p_brand, 7)")).alias(
                "product_category_name_english"
            ),
        )
    )


def derive_payments(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.when(k % 4 == 0, "voucher").otherwise("card").alias("payment_type"),
        (k % 12 + 1).cast("int").alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
    )


def derive_geolocation(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    geo = _geo(nation, region).withColumnRenamed("n_nationkey", "c_nationkey")
    k = F.col("c_custkey")
    return customer.join(F.broadcast(geo), "c_nationkey", "left").select(
        F.lpad((k % 100_000).cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
        (k % 180 - 90).cast("double").alias("geolocation_lat"),
        (k % 360 - 180).cast("double").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.col("r_name").alias("geolocation_state"),
    )


@dataclass(frozen=True)
class TpchSource:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


def raw_model(spark: SparkSession, sf_dir: str, full: bool = False) -> RawModel:
    """The raw order model derived from the TPC-H-like tables under ``sf_dir``;
    with ``full`` also payments and geolocation, which no analysis joins."""
    src = TpchSource(spark, sf_dir)
    orders = src.table("orders")
    nation, region = src.table("nation"), src.table("region")
    lineitem = src.table("lineitem")
    partitions = item_partitions(lineitem)
    return RawModel(
        orders=derive_orders(orders),
        order_items=derive_order_items(lineitem, orders, partitions),
        order_reviews=derive_order_reviews(src.table("events")),
        customers=derive_customers(src.table("customer"), nation, region),
        sellers=derive_sellers(src.table("supplier"), nation, region),
        products=derive_products(src.table("part")),
        product_category_translation=derive_translation(src.table("part")),
        order_payments=derive_payments(orders) if full else None,
        geolocation=derive_geolocation(src.table("customer"), nation, region) if full else None,
        item_partitions=partitions,
    )
