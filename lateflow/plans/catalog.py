"""Register the stored layers as catalog tables, under the reference's names.

After ``register_tables`` the raw layer is ``raw.<table>`` and the facts are
``analytics.fact_order_fulfillment`` / ``analytics.fact_order_lines``, so ad
hoc SQL written against those table names runs through ``spark.sql``.

The tables are external: they point at the current versions written by the
loader and the fact build (in shared storage; register again after a refresh), and each database's location
is that same folder, so nothing lands in a machine-local warehouse.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lateflow.sources.schemas import LOAD_PLAN

FACT_TABLES = ("fact_order_fulfillment", "fact_order_lines")


def _register(spark: SparkSession, db: str, root: str, tables) -> list[str]:
    from lateflow.sources.ingest import source_exists, table_path

    root = root.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}'")
    names = []
    for table in tables:
        if not source_exists(spark, f"{root}/{table}"):
            continue  # e.g. a raw layer stored without payments or geolocation
        at = table_path(spark, root, table)
        name = f"{db}.{table}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the data stays
        spark.catalog.createTable(name, path=at, source="parquet")
        if any(c.isPartition for c in spark.catalog.listColumns(name)):
            spark.catalog.recoverPartitions(name)  # e.g. the fact's purchase_month folders
        names.append(name)
    return names


def register_tables(
    spark: SparkSession,
    raw_root: str,
    facts_root: str | None = None,
    raw_db: str = "raw",
    analytics_db: str = "analytics",
) -> list[str]:
    """Create (or replace) external tables over the stored layers; return their names."""
    names = _register(spark, raw_db, raw_root, [spec.table for spec in LOAD_PLAN])
    if facts_root:
        names += _register(spark, analytics_db, facts_root, FACT_TABLES)
    return names
