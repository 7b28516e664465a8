"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join back to it, so a hub with very many
neighbours is pre-aggregated and its join can be split. Each round is a
table in the shared checkpoint folder, removed when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import discard, store


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``edges (a long, b long)``; the root is the smallest id reachable."""
    links = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: neighbours above u move to the smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below it move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    out = store(links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots))
    discard(links)
    return out
