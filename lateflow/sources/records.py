"""Records of CSV files whose quoted fields hold line breaks, read by many tasks.

Spark cannot split such a file with ``multiLine``. Here it is read as physical
lines, which split at any byte range, and the quoting state is carried through them:

1. Each line maps the state at its start (outside or inside a quoted field) to
   the state at its end. Doubled quotes drop out; a quote opens a field only
   at the field's start, closes it anywhere, and is text in an unquoted field.
   A line without quotes keeps the state, most others swap it or set it whatever it was.
2. Running sums over the lines of a split (one task's byte range) compose these maps,
   and a prefix over the splits of a file gives the state at each split's start.
3. A line that starts outside a quoted field starts a record. Records of one line pass
   through; the lines of longer ones are joined, within their split or, for the one
   record that crosses a split's end, over the (two per split) fragments at split ends.

Lines are shuffled once by split, so a file of any size loads in as many tasks as it
has splits. Nothing is collected; windows over a whole file hold one or two rows per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ("file", "block")


def _opens(c: Column) -> Column:
    """1 if a line without doubled quotes, read from outside, ends inside a quoted field."""
    closed_gone = F.regexp_replace(c, '(^|,)"[^"]*+"', "$1")
    return closed_gone.rlike('(^|,)"').cast("int")


def line_maps(value: Column) -> tuple[Column, Column]:
    """State (0 outside, 1 inside a quoted field) after a line that starts outside, and after one that starts inside."""
    single = F.replace(value, F.lit('""'), F.lit(""))
    quoted = F.contains(value, F.lit('"'))
    close = F.locate('"', single)
    # what follows a closing quote is not the start of a field
    after = F.concat(F.lit("x"), F.substring(single, close + 1, F.length(single)))
    from_inside = F.when(close == 0, 1).otherwise(_opens(after))
    return F.when(quoted, _opens(single)).otherwise(0), F.when(quoted, from_inside).otherwise(1)


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, i, value``: lines cut at line feeds only, with the byte range they were read in and their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace("value", r"^\x{FEFF}", "")).otherwise(F.col("value"))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"),
        value.alias("value"),
    )


def _with_states(lines: DataFrame, *keep: str) -> DataFrame:
    """Per line the map from the split's start to the line's start (``known`` and ``bit``: set to the bit, or else swapped by it)
    and to its end (``after_known``, ``after_bit``)."""
    out, inside = line_maps(F.col("value"))
    mapped = lines.select(*SPLIT, "i", *keep, out.alias("out"), inside.alias("inside"))
    sets, swaps = F.col("out") == F.col("inside"), (F.col("out") == 1) & (F.col("inside") == 0)
    order = Window.partitionBy(*SPLIT).orderBy("i")
    mapped = mapped.withColumn("swaps", F.sum(swaps.cast("int")).over(order))
    last = F.last(F.when(sets, F.struct(F.col("out").alias("to"), F.col("swaps").alias("at"))), ignorenulls=True)
    mapped = mapped.withColumn("set", last.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    since = F.col("swaps") - swaps.cast("int") - F.coalesce("set.at", F.lit(0))
    mapped = mapped.withColumns({"known": F.col("set").isNotNull(), "bit": (F.coalesce("set.to", F.lit(0)) + since) % 2})
    after = F.when(sets, F.col("out")).otherwise((F.col("bit") + swaps.cast("int")) % 2)
    return mapped.select(*SPLIT, "i", *keep, "known", "bit", (sets | F.col("known")).alias("after_known"), after.alias("after_bit"))


def split_starts(lines: DataFrame) -> DataFrame:
    """``file, block, start``: the quoting state at the start of each split; one row per split."""
    states = _with_states(lines)
    code = F.col("i") * 4 + F.col("after_known").cast("int") * 2 + F.col("after_bit")
    ends = states.groupBy(*SPLIT).agg((F.max(code) % 4).alias("code"))
    order = Window.partitionBy("file").orderBy("block")
    ends = ends.select(*SPLIT, (F.col("code") >= 2).alias("sets"), (F.col("code") % 2).alias("bit"))
    ends = ends.withColumn("swaps", F.sum(F.when(~F.col("sets"), F.col("bit")).otherwise(0)).over(order))
    last = F.last(F.when(F.col("sets"), F.struct("bit", "swaps")), ignorenulls=True)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps_before = F.coalesce(F.max("swaps").over(before), F.lit(0))  # it never falls
    start = (F.coalesce(last.over(before)["bit"], F.lit(0)) + swaps_before - F.coalesce(last.over(before)["swaps"], F.lit(0))) % 2
    return ends.select(*SPLIT, start.cast("int").alias("start"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, rec, record``: every record of the file or folder of files at ``path``, as it stands in the file.

    ``(block, rec)`` orders the records of a file; its first record (the header) is ``(0, 1)``.
    """
    lines = physical_lines(spark, path)
    starts = split_starts(lines)
    states = _with_states(lines, "value").join(starts, list(SPLIT))
    at = lambda known, bit: (F.when(known, F.col(bit)).otherwise(F.col(bit) + F.col("start")) % 2).cast("int")
    states = states.select(*SPLIT, "i", "value", at(F.col("known"), "bit").alias("state"), at(F.col("after_known"), "after_bit").alias("after"))
    order = Window.partitionBy(*SPLIT).orderBy("i")
    states = states.withColumn("rec", F.sum((F.col("state") == 0).cast("int")).over(order))
    whole = (F.col("state") == 0) & (F.col("after") == 0)
    single = states.where(whole).select(*SPLIT, "rec", F.col("value").alias("record"))

    def joined(parts: DataFrame, keys: list[str], order: list[str], *more: Column) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
        return parts.groupBy(*keys).agg(rows.alias("parts"), *more).withColumn("value", F.array_join(F.transform("parts", lambda p: p["value"]), "\n"))

    pieces = joined(states.where(~whole), [*SPLIT, "rec"], ["i"], F.max(F.col("i") * 2 + F.col("after")).alias("last"))
    pieces = pieces.select(*SPLIT, "rec", "value", (F.col("last") % 2 == 1).alias("open"))
    closed = pieces.where((F.col("rec") > 0) & ~F.col("open")).select(*SPLIT, "rec", F.col("value").alias("record"))
    # the fragments at split ends: two per split at most
    owner = F.sum((F.col("rec") > 0).cast("int")).over(Window.partitionBy("file").orderBy("block", "rec"))
    ends = pieces.where((F.col("rec") == 0) | F.col("open")).withColumn("owner", owner)
    first = F.min(F.struct("block", "rec")).alias("first")
    across = joined(ends, ["file", "owner"], ["block", "rec"], first).select("file", "first.block", "first.rec", F.col("value").alias("record"))
    records = single.unionByName(closed).unionByName(across)
    return records.select(*SPLIT, "rec", F.regexp_replace("record", r"\r\z", "").alias("record"))
