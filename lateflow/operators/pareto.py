"""Pareto of defects by seller (Q2), its full curve, and high-rate sellers (T4).

The reference ranks every qualifying seller with windows that have no
PARTITION BY (cumulative sum, row number, table totals). In Spark such a
window sends the whole table through one task. Two distributed forms:

``pareto`` (the report, top ``k`` rows)
    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject -- each task
    keeps its own top k and only k rows per task meet -- and the windows then
    run over those k rows. Table totals (late deliveries, seller count) are
    scalar subqueries over the qualifying sellers; Catalyst merges them and
    reuses the seller aggregation's exchange, so the fact is scanned once.

``pareto_full_curve`` (every qualifying seller)
    Lazy, without an action or a checkpoint (``ranks_by_value``): sellers are
    counted by (late count, cell of ids), where a cell is a short key in the order of the ids.
    Prefix sums over the distinct late counts, then over the cells of one
    late count, give the offsets; only rows of one late count and one cell
    are numbered in one window, so the late count 0, which most sellers may have, is split.

``prefix_rank`` (any total order)
    A global sort (range-partitioned) whose rows are
    tagged with their partition and place and then checkpointed in the session's shared
    folder. The tags are data from then on, so whatever is done with the
    result (coalesce, union, limit) gives the same ranks. Running sums are
    windows within a range partition; per-partition totals (one row per
    partition) turned into offsets are broadcast back -- that side is bounded
    by the partition count, not by the data.

Ordering is ``late_orders DESC`` with ``seller_id`` and ``seller_state`` as
tie-breaks, so ranks are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateflow.functions.exact import pct, rate_scaled
from lateflow.session import checkpoint_root

SELLER = ("seller_id", "seller_state")


def seller_defects(
    fact: DataFrame, min_rows: int = 30, entity: tuple[str, ...] = SELLER, weight: str = "is_late"
) -> DataFrame:
    """Per entity (default: seller and its state): ``orders`` and
    ``late_orders`` (the sum of the 0/1 ``weight``), entities with at least
    ``min_rows`` orders. Rows with a NULL first entity column are skipped."""
    return (
        fact.filter(F.col(entity[0]).isNotNull())
        .groupBy(*entity)
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(weight).cast("bigint").alias("late_orders"))
        .filter(F.col("orders") >= min_rows)
    )


def _order_keys(entity: tuple[str, ...] = SELLER):
    return [F.desc("late_orders"), F.asc(entity[0])] + [F.asc_nulls_first(c) for c in entity[1:]]


def pareto(
    fact: DataFrame,
    min_rows: int = 30,
    top: int = 25,
    entity: tuple[str, ...] = SELLER,
    weight: str = "is_late",
    rank_name: str = "seller_rank",
) -> DataFrame:
    """Q2: top entities by defects with cumulative share of all defects."""
    sd = seller_defects(fact, min_rows, entity, weight)
    total_late = sd.select(F.sum("late_orders")).scalar()
    total_sellers = sd.select(F.count(F.lit(1))).scalar()
    head = sd.orderBy(*_order_keys(entity)).limit(top)
    w = Window.orderBy(*_order_keys(entity))
    ranked = head.withColumns(
        {
            rank_name: F.row_number().over(w).cast("bigint"),
            "_cum": F.sum("late_orders").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    return ranked.select(
        rank_name,
        *entity,
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        pct("_cum", total_late).alias("cum_pct_of_all_defects"),
        pct(rank_name, total_sellers).alias("pct_of_sellers"),
    ).orderBy(rank_name)


def prefix_rank(df: DataFrame, order_cols: list, value_col: str) -> DataFrame:
    """Global 1-based row number ``_rank``, running sum ``_cum`` of ``value_col``
    in the total order ``order_cols``, and over all rows ``_rows`` and ``_total``,
    without a single-partition window.

    ``order_cols`` must define a total order (include a unique key) so that
    ranks are deterministic. Needs ``spark.checkpoint.dir``.
    """
    checkpoint_root(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    tagged = df.orderBy(*order_cols).withColumns({"_pid": F.spark_partition_id(), "_i": place}).checkpoint(eager=True)
    part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(value_col).alias("_s"))
    # One row per partition: bounded by the partition count, never by the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = part.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off_s"),
        F.sum("_n").over(everything).alias("_rows"),
        F.sum("_s").over(everything).alias("_total"),
    )
    local = Window.partitionBy("_pid").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tagged.withColumn("_own", F.sum(value_col).over(local))
        .join(F.broadcast(offsets), "_pid")
        .select(
            *df.columns,
            (F.col("_off_n") + F.col("_i") + 1).alias("_rank"),
            (F.col("_off_s") + F.col("_own")).alias("_cum"),
            "_rows",
            "_total",
        )
    )


def id_cell(df: DataFrame, column: str, width: int = 2, span: int = 4096) -> Column:
    """A coarse key in the order of ``column``: the first ``width`` characters of a text, ``span`` numbers in a row; null stays null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.substring(column, 1, width)
    return F.floor(F.col(column) / F.lit(span))


def ranks_by_value(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    """1-based row number ``_rank`` and running sum ``_cum`` of ``value_col`` in the order of ``value_col`` descending, then ``keys``
    ascending (nulls first), and over all rows ``_rows`` and ``_total``.

    ``keys`` must be unique. Values must repeat, as counts do: the one window without
    partitions runs over the distinct values. Any ``df`` that reads its source alike each time gives the same ranks, whatever is done with them.
    """
    cell = id_cell(df, keys[0])
    tagged = df.withColumn("_cell", cell)
    cells = tagged.groupBy(value_col, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    per_value = cells.groupBy(value_col).agg(F.sum("_n").alias("_n"))
    falling = Window.orderBy(F.desc(value_col)).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    values = per_value.select(
        value_col,
        F.coalesce(F.sum("_n").over(falling), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.col("_n") * F.col(value_col)).over(falling), F.lit(0)).alias("_sum"),
        F.sum("_n").over(everything).alias("_rows"),
        F.sum(F.col("_n") * F.col(value_col)).over(everything).alias("_total"),
    )
    in_value = Window.partitionBy(value_col).orderBy(F.asc_nulls_first("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(value_col, F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(in_value), F.lit(0)).alias("_start")).join(values, value_col)
    in_cell = Window.partitionBy(value_col, "_cell").orderBy(*(F.asc_nulls_first(k) for k in keys))
    own = tagged.withColumn("_own", F.row_number().over(in_cell)).withColumnRenamed(value_col, "_v")
    joined = own.join(starts, (F.col("_v") == F.col(value_col)) & F.col("_cell").eqNullSafe(F.col("_c")))
    place = F.col("_start") + F.col("_own")
    return joined.select(
        *df.columns,
        (F.col("_before") + place).alias("_rank"),
        (F.col("_sum") + place * F.col(value_col)).alias("_cum"),
        "_rows",
        "_total",
    )


def pareto_full_curve(
    fact: DataFrame,
    min_rows: int = 30,
    entity: tuple[str, ...] = SELLER,
    weight: str = "is_late",
    rank_name: str = "seller_rank",
) -> DataFrame:
    """Q2 for every qualifying entity: rank, cumulative defects and shares."""
    ranked = ranks_by_value(seller_defects(fact, min_rows, entity, weight), "late_orders", list(entity))
    return ranked.select(
        F.col("_rank").alias(rank_name),
        *entity,
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
        F.col("_cum").alias("cum_late"),
        pct("_cum", "_total").alias("cum_pct_of_all_defects"),
        pct("_rank", "_rows").alias("pct_of_sellers"),
    )


def high_rate_sellers(
    fact: DataFrame, min_rows: int = 30, top: int = 25, entity: tuple[str, ...] = SELLER, weight: str = "is_late"
) -> DataFrame:
    """T4: the qualifying entities with the highest late *rate* (volume beside it).

    Same input as Q2, ordered by exact rate, then by volume, then entity.
    """
    sd = seller_defects(fact, min_rows, entity, weight).withColumn("_rate", rate_scaled("late_orders", "orders"))
    keys = [F.desc("_rate"), F.desc("orders"), F.asc(entity[0])] + [F.asc_nulls_first(c) for c in entity[1:]]
    head = sd.orderBy(*keys).limit(top)
    return head.select(
        F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("rate_rank"),
        *entity,
        "orders",
        "late_orders",
        pct("late_orders", "orders").alias("late_rate_pct"),
    ).orderBy("rate_rank")
