"""Data-quality checks (V1-V4, V6, V7) as DataFrame -> DataFrame jobs.

Each check returns a small report DataFrame; nothing is collected. Counts are
global aggregates (one partial row per task); key and orphan checks
pre-aggregate by key before any shuffle or join, so a hot key costs one row
per task, not its full row count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count_check(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """V1: one row per table: table_name, actual_rows, expected_rows, matches.

    ``expected_rows`` is NULL where no expectation exists; ``matches`` then
    is NULL too.
    """
    expected = expected or {}
    parts = []
    for name, df in tables.items():
        exp = expected.get(name)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("actual_rows")).select(
                F.lit(name).alias("table_name"),
                "actual_rows",
                F.lit(exp).cast("bigint").alias("expected_rows"),
            )
        )
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("matches", F.col("actual_rows") == F.col("expected_rows"))


def schema_check(df: DataFrame, expected: T.StructType) -> list[tuple[str, str, str, bool]]:
    """V2: compare a DataFrame's column types to an expected schema.

    Metadata only (no data is read): returns (column, expected_type,
    actual_type, ok) for every expected column; a missing column has
    actual_type ``'missing'``.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in expected.fields:
        got = actual.get(f.name)
        out.append(
            (f.name, f.dataType.simpleString(), got.simpleString() if got else "missing", got == f.dataType)
        )
    return out


def schema_report(spark, df: DataFrame, expected: T.StructType) -> DataFrame:
    """V2 as a DataFrame (one row per expected column)."""
    schema = "column_name string, expected_type string, actual_type string, ok boolean"
    return spark.createDataFrame(schema_check(df, expected), schema)


def orphan_check(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """V3: child rows whose key has no parent row (expect 0).

    The child is reduced to (key, rows) first, so the anti join shuffles one
    row per distinct key instead of every child row.
    """
    parent_key = parent_key or key
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    parents = parent.select(F.col(parent_key).alias(key))
    orphans = keys.join(parents, key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphan_rows"))


def key_check(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """V4: primary-key health per table (Spark does not enforce keys).

    One row per table: rows, null_keys, distinct_keys, duplicated_keys
    (non-null key values appearing more than once), is_unique.
    """
    parts = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            per_key.agg(
                F.sum("_n").cast("bigint").alias("rows"),
                F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
                F.count("_k").alias("distinct_keys"),
                F.count_if(F.col("_k").isNotNull() & (F.col("_n") > 1)).alias("duplicated_keys"),
            ).select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "*")
        )
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("is_unique", (F.col("null_keys") == 0) & (F.col("duplicated_keys") == 0))


def fact_lines_summary(lines: DataFrame) -> DataFrame:
    """V6: line rows, distinct orders, distinct categories, 'unknown' lines.

    Orders and categories are each rolled up by their own key first, so no
    line is expanded into one row per distinct count."""
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("category_en") == "unknown").alias("_u")
    )
    categories = lines.select("category_en").distinct().select(F.count("category_en")).scalar()
    return per_order.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("line_rows"),
        F.count("order_id").alias("distinct_orders"),
        F.coalesce(F.sum("_u"), F.lit(0)).cast("bigint").alias("unknown_category"),
    ).select("line_rows", "distinct_orders", categories.alias("categories"), "unknown_category")


def reconcile_labels(df: DataFrame, label: str, first: Column, second: Column, measure: str, names=("a", "b")) -> DataFrame:
    """V7 in one pass: how many rows each of two labellings puts under each label.

    Rows are counted once by the pair of labels (a table as small as the two
    label sets); both counts and their difference (second minus first) come from it.
    """
    pairs = df.groupBy(first.alias("_a"), second.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    ca, cb = f"{measure}_{names[0]}", f"{measure}_{names[1]}"
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("_a").alias(label), F.col("_n").alias(ca), F.lit(0).cast("bigint").alias(cb)),
                F.struct(F.col("_b").alias(label), F.lit(0).cast("bigint").alias(ca), F.col("_n").alias(cb)),
            )
        ).alias("_s")
    ).select("_s.*")
    return (
        sides.groupBy(label)
        .agg(F.sum(ca).cast("bigint").alias(ca), F.sum(cb).cast("bigint").alias(cb))
        .withColumn("diff", F.col(cb) - F.col(ca))
        .orderBy(label)
    )


def _row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of a row; nulls count, so values cannot slide from one column to the next."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def bucket_digests(df: DataFrame, keys: list[str], columns: list[str], buckets: int) -> DataFrame:
    """Per bucket of keys: rows and two order-free digests of all of them (XOR of one row hash, sum of another)."""
    bucket = F.pmod(_row_hash(keys, 1), F.lit(buckets)).cast("int").alias("_bucket")
    return df.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bit_xor(_row_hash(columns, 2)).alias("_xor"),
        F.sum(_row_hash(columns, 3).cast("decimal(20,0)")).alias("_sum"),
    )


def differing_buckets(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], buckets: int) -> DataFrame:
    """Buckets whose digests differ, or that only one side has: at most ``buckets`` rows."""
    left, right = bucket_digests(a, keys, columns, buckets), bucket_digests(b, keys, columns, buckets)
    both = left.alias("l").join(right.alias("r"), "_bucket", "full_outer")
    same = F.lit(True)
    for c in ("_rows", "_xor", "_sum"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return both.where(~same).select("_bucket")


_EXACT = (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType)


def _compared_as(column: str, a: DataFrame, b: DataFrame) -> Column:
    """A column in the form in which two results compare it: its own where equal values and equal texts are the same thing, else text."""
    kind = a.schema[column].dataType
    return F.col(column) if isinstance(kind, _EXACT) and kind == b.schema[column].dataType else F.col(column).cast("string").alias(column)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """V7: every difference between two results with the same columns: ``keys``, ``status``, ``column_name``, ``value_a``, ``value_b``.

    ``status`` is ``only a`` or ``only b`` for rows that one side lacks (no column), else ``differs`` with a row for
    each column that differs, values as text. Rows with equal keys are paired in the order of their contents.

    Each side is first reduced to a digest per bucket of keys. Only rows of buckets
    that differ are shuffled and compared, so two results that agree cost one scan each. Numbers, dates and stamps
    travel as they are; only values that differ become texts.
    """
    columns = list(a.columns)
    if sorted(columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {columns} and {b.columns}")
    values = [c for c in columns if c not in keys]
    differing = F.broadcast(differing_buckets(a, b, keys, columns, buckets))  # at most ``buckets`` numbers

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select("*", F.pmod(_row_hash(keys, 1), F.lit(buckets)).cast("int").alias("_bucket")).join(differing, "_bucket", "left_semi")
        order = Window.partitionBy(*keys).orderBy(_row_hash(columns, 2), _row_hash(columns, 3))
        compared = F.struct(*(_compared_as(c, a, b) for c in values)).alias(name)
        return own.withColumn("_copy", F.row_number().over(order)).select(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)), F.col("_copy").alias(f"{name}_copy"), compared)

    left, right = side(a, "_a"), side(b, "_b")
    on = F.col("_a_copy") == F.col("_b_copy")
    for i in range(len(keys)):
        on = on & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    joined = left.join(right, on, "full_outer")
    said = lambda status, column, x, y: F.struct(F.lit(status).alias("status"), F.lit(column).cast("string").alias("column_name"), x.alias("value_a"), y.alias("value_b"))
    none = F.lit(None).cast("string")
    of_column = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), said("differs", c, F.col(f"_a.{c}").cast("string"), F.col(f"_b.{c}").cast("string"))) for c in values]
    found = F.when(F.col("_b_copy").isNull(), F.array(said("only a", None, none, none))).when(F.col("_a_copy").isNull(), F.array(said("only b", None, none, none)))
    found = found.otherwise(F.array_compact(F.array(*of_column)))
    key_columns = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    return joined.select(*key_columns, F.explode(found).alias("_d")).select(*keys, "_d.*")
