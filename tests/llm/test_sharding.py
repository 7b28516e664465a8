from __future__ import annotations

import random
import zlib
from collections import defaultdict

from lateflow.llm import sharding


def test_lpt_is_greedy():
    r = random.Random(1)
    sizes = [r.randrange(1, 100) for _ in range(200)]
    got, load = sharding.lpt(sizes, 7), [0] * 7
    for i in sorted(range(200), key=lambda i: (-sizes[i], i)):
        assert load[got[i]] == min(load)
        load[got[i]] += sizes[i]


def test_rows(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["x" * r.randrange(400), "hot text", None, ""]), "s") for i in range(1200)] + [(5, "hot text", "s"), (None, "n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard_documents(docs, n_shards=5, exact_groups=20, bundles=300).collect()
    assert len(out) == len(rows)
    assert sorted((x["doc_id"] or 0, x["size"], x["text_crc32"] or 0) for x in out) == sorted(
        (i or 0, len(t or "") + 16, 0 if t is None else zlib.crc32(t.encode())) for i, t, _ in rows
    )
    by, loads, shard_of = defaultdict(list), defaultdict(int), defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for x in out:
        by[x["shard"]].append(x["slot"])
        loads[x["shard"]] += x["size"]
        shard_of[text[x["doc_id"]]].add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in shard_of.values())
    rest = [v for v in loads.values() if v < max(loads.values())]
    assert max(rest) - min(rest) < 1000
    assert sharding.shard_documents(docs.limit(0)).count() == 0
