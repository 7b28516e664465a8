"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups are taken in
falling order of bytes and each goes to the shard with the least load, held in
a heap. The driver schedules a bounded number of units: up to ``exact_groups``
of the largest groups one by one, and all smaller groups bundled by a hash of their
text into ``bundles`` units (with fewer groups than either bound, a unit is
nearly always one group). Both bounds are parameters, hold for any input size,
and no row is left out.

Slots number the rows of a shard without gaps. Rows are ranked within
(shard, cell), where the cell is a hash of the row id, and cells are offset by
the counts of the cells before them, so a group that holds a third of all rows
is ranked by many tasks.

Defined cases: a null text counts 0 bytes, has a null crc and forms one group
of its own (apart from the empty text); repeated rows and ids each get their
own slot; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateflow.llm.common import cut


def lpt(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each unit: units in falling order of size to the least-loaded shard."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heap[0]
        shard[i] = s
        heapq.heapreplace(heap, (load + sizes[i], s))
    return shard


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    exact_groups: int = 20_000,
    bundles: int = 20_000,
    cells: int = 256,
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``docs``."""
    spark, text = docs.sparkSession, F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("_group"),
        ).withColumn("_bundle", F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int"))
    )
    groups = cut(rows.groupBy("_group", "_bundle").agg(F.sum("size").alias("bytes")))
    # the largest groups, by a threshold on a histogram of sizes: what is collected is bounded whatever the number of tasks
    step = F.floor(F.log2(F.col("bytes").cast("double")) * 64).cast("int")
    least, count = None, 0
    for r in sorted(groups.groupBy(step.alias("step")).count().collect(), reverse=True):
        count += r["count"]
        if count > exact_groups:
            break
        least = r["step"]
    large = groups.where(step >= least if least is not None else F.lit(False)).orderBy(F.desc("bytes"), "_group").select("_group", "_bundle", "bytes").collect()
    taken: dict[int, int] = {}
    for g in large:
        taken[g["_bundle"]] = taken.get(g["_bundle"], 0) + g["bytes"]
    sums = groups.groupBy("_bundle").agg(F.sum("bytes").alias("bytes")).collect()
    rest = [(b["_bundle"], b["bytes"] - taken.get(b["_bundle"], 0)) for b in sums]
    rest = sorted((x for x in rest if x[1] > 0), key=lambda x: x[0])
    shard = lpt([g["bytes"] for g in large] + [n for _, n in rest], n_shards)

    # Both lookup tables are bounded by the two parameters, whatever the input.
    own = spark.createDataFrame([(g["_group"], s) for g, s in zip(large, shard)], "_group binary, own int")
    bundled = spark.createDataFrame([(b, s) for (b, _), s in zip(rest, shard[len(large):])], "_bundle int, bundled int")
    placed = (
        rows.join(F.broadcast(own), "_group", "left")
        .join(F.broadcast(bundled), "_bundle", "left")
        .withColumn("shard", F.coalesce("own", "bundled"))
        .withColumn("_cell", F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(cells)).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_group", id_col))
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), ["shard", "_cell"])  # n_shards x cells rows at most
        .select(id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("_rank") - 1).cast("long").alias("slot"))
    )
