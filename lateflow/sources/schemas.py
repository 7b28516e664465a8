"""Fixed schemas of the raw layer, the load plan, and the raw-model container.

Types follow the reference DDL: NVARCHAR -> string, INT -> int, FLOAT ->
double, DECIMAL(12,2) -> decimal(12,2), DATETIME2 -> timestamp_ntz. Zip-code
prefixes stay strings so leading zeros survive. Schemas are always passed to
the reader; nothing is inferred.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


CUSTOMERS = _schema(
    ("customer_id", S, False),
    ("customer_unique_id", S, True),
    ("customer_zip_code_prefix", S, True),
    ("customer_city", S, True),
    ("customer_state", S, True),
)
SELLERS = _schema(
    ("seller_id", S, False),
    ("seller_zip_code_prefix", S, True),
    ("seller_city", S, True),
    ("seller_state", S, True),
)
PRODUCTS = _schema(
    ("product_id", S, False),
    ("product_category_name", S, True),
    ("product_name_lenght", I, True),
    ("product_description_lenght", I, True),
    ("product_photos_qty", I, True),
    ("product_weight_g", D, True),
    ("product_length_cm", D, True),
    ("product_height_cm", D, True),
    ("product_width_cm", D, True),
)
CATEGORY_TRANSLATION = _schema(
    ("product_category_name", S, True),
    ("product_category_name_english", S, True),
)
ORDERS = _schema(
    ("order_id", S, False),
    ("customer_id", S, True),
    ("order_status", S, True),
    ("order_purchase_timestamp", TS, True),
    ("order_approved_at", TS, True),
    ("order_delivered_carrier_date", TS, True),
    ("order_delivered_customer_date", TS, True),
    ("order_estimated_delivery_date", TS, True),
)
ORDER_ITEMS = _schema(
    ("order_id", S, False),
    ("order_item_id", I, True),
    ("product_id", S, True),
    ("seller_id", S, True),
    ("shipping_limit_date", TS, True),
    ("price", MONEY, True),
    ("freight_value", MONEY, True),
)
ORDER_PAYMENTS = _schema(
    ("order_id", S, False),
    ("payment_sequential", I, True),
    ("payment_type", S, True),
    ("payment_installments", I, True),
    ("payment_value", MONEY, True),
)
ORDER_REVIEWS = _schema(
    ("review_id", S, True),
    ("order_id", S, True),
    ("review_score", I, True),
    ("review_comment_title", S, True),
    ("review_comment_message", S, True),
    ("review_creation_date", TS, True),
    ("review_answer_timestamp", TS, True),
)
GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", S, True),
    ("geolocation_lat", D, True),
    ("geolocation_lng", D, True),
    ("geolocation_city", S, True),
    ("geolocation_state", S, True),
)


@dataclass(frozen=True)
class TableSpec:
    """One entry of the load plan: source file, target table, typed schema.

    ``multiline`` marks files whose quoted fields hold line breaks; Spark
    cannot split such a file, so only the file that needs it pays for it.
    """

    file: str
    table: str
    schema: T.StructType
    multiline: bool = False

    @property
    def timestamp_columns(self) -> list[str]:
        return [f.name for f in self.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]


# The source file names and target tables of the load plan, in
# load order.
LOAD_PLAN: tuple[TableSpec, ...] = (
    TableSpec("olist_customers_dataset.csv", "customers", CUSTOMERS),
    TableSpec("olist_sellers_dataset.csv", "sellers", SELLERS),
    TableSpec("olist_products_dataset.csv", "products", PRODUCTS),
    TableSpec("product_category_name_translation.csv", "product_category_translation", CATEGORY_TRANSLATION),
    TableSpec("olist_orders_dataset.csv", "orders", ORDERS),
    TableSpec("olist_order_items_dataset.csv", "order_items", ORDER_ITEMS),
    TableSpec("olist_order_payments_dataset.csv", "order_payments", ORDER_PAYMENTS),
    TableSpec("olist_order_reviews_dataset.csv", "order_reviews", ORDER_REVIEWS, multiline=True),
    TableSpec("olist_geolocation_dataset.csv", "geolocation", GEOLOCATION),
)

SCHEMAS: dict[str, T.StructType] = {spec.table: spec.schema for spec in LOAD_PLAN}

# Row counts the reference expects after loading its dataset
# (the translation table has no expected count).
EXPECTED_ROWS: dict[str, int] = {
    "orders": 99441,
    "order_items": 112650,
    "order_payments": 103886,
    "order_reviews": 99224,
    "customers": 99441,
    "products": 32951,
    "sellers": 3095,
    "geolocation": 1000163,
}

# pandas' default NA tokens (keep_default_na=True), matched
# against the untrimmed field text.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


@dataclass(frozen=True)
class RawModel:
    """The raw layer as DataFrames. Payments and geolocation are loaded and
    checked by the reference but joined by no analysis, so they are optional.
    ``item_partitions``: partitions for joins of all items by order, where the source knows its size."""

    orders: DataFrame
    order_items: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    product_category_translation: DataFrame
    order_payments: DataFrame | None = field(default=None)
    geolocation: DataFrame | None = field(default=None)
    item_partitions: int | None = field(default=None)

    def tables(self) -> dict[str, DataFrame]:
        out = {}
        for f in fields(self):
            df = getattr(self, f.name)
            if isinstance(df, DataFrame):
                out[f.name] = df
        return out


# Case- and trailing-blank-insensitive, accent-sensitive: the comparison
# semantics of the reference database's default collation.
CI_RTRIM = "UTF8_LCASE_RTRIM"


def with_collation(raw: RawModel, collation: str = CI_RTRIM) -> RawModel:
    """Opt-in: give every string column of the raw model ``collation``.

    Spark compares, joins and groups strings byte-wise by default ('SP' <>
    'sp', 'a' <> 'a '). With a collated raw layer every downstream equality,
    join key, filter and GROUP BY follows the collation instead (Spark plans
    joins on collation keys), while the stored text is unchanged.
    """
    from pyspark.sql import functions as F

    def collate(df: DataFrame) -> DataFrame:
        cols = [
            F.collate(F.col(f.name), collation).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*cols)

    return replace(raw, **{name: collate(df) for name, df in raw.tables().items()})
