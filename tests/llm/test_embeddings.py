from __future__ import annotations

import itertools
import math
import random

import numpy as np

from lateflow.llm import embeddings


def brute(rows, threshold):
    n = len(rows)
    links = [set() for _ in rows]
    ok = [v is not None and len(v) > 0 and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in links[i])])
            moved, root[i] = moved or low != root[i], low
    least = {r: min(rows[i][0] for i in range(n) if root[i] == r) for r in set(root)}
    return {rows[i][0]: (len(links[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(n)}


def test_against_brute_force(spark):
    r, g = random.Random(1), np.random.default_rng(1)
    rows = []
    for c in range(30):
        center = g.standard_normal(12)
        for _ in range(12):
            noise = g.standard_normal(12) * r.choice([0, 0.02, 0.1, 0.15])
            rows.append([(center + noise).astype(np.float32).tolist(), r.choice([0, 1, c % 4])])
    center = g.standard_normal(12)
    rows += [[(center + g.standard_normal(12) * 0.01).astype(np.float32).tolist(), 3] for _ in range(150)]  # near copies
    rows += [[center.astype(np.float32).tolist(), 3]] * 60  # copies
    rows += [[None, 1], [[], 1], [[0.0] * 12, 1], [[None] + [1.0] * 11, 1], [[float("nan")] + [1.0] * 11, 2], [[float("inf")] + [1.0] * 11, 2]]
    rows += [[center.tolist(), None], [[1.0, 2.0, 3.0], 0], [[2.0, 4.0, 6.0], 0], [[1e30] * 12, 0], [[1e30] * 12, 0]]
    ids = r.sample(range(5000), len(rows))
    rows = [(i, v, l) for i, (v, l) in zip(ids, rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    out = embeddings.near_duplicates(table, 0.93, part_rows=40, codewords=6).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    want = brute(rows, 0.93)
    assert len(out) == len(rows)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in out}
    assert got == want
    some = embeddings.near_duplicates(table, 0.93, part_rows=40, codewords=6, target_recall=0.9).collect()
    assert sum(x["n_links"] for x in some) >= 0.9 * sum(n for n, *_ in want.values())
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_visits_are_ordered():
    order = list(embeddings.multi_sequence(np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0])))
    total = [[3.0, 1.0, 2.0][a] + [0.5, 4.0][b] for a, b in order]
    assert total == sorted(total) and len(set(order)) == 6


def test_links_count_on_both_sides(spark):
    """Many vectors of 16 dimensions around shared centers, few codewords and many: all links, each counted twice."""
    g = np.random.default_rng(6)
    centers = g.standard_normal((60, 16))
    x = (centers[g.integers(0, 60, 1500)] + 0.25 * g.standard_normal((1500, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)] + [(1, x[0].tolist(), 1, 0.1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node double").repartition(3)
    unit = np.array([r[1] for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    want = sorted((r[0], int(n) - 1) for r, n in zip(rows, linked.sum(1)))
    assert sum(n for _, n in want) > 5000
    for codewords in (4, 24):
        got = embeddings.near_duplicates(table, 0.93, codewords=codewords, part_rows=100).collect()
        assert sorted((r["vec_id"], r["n_links"]) for r in got) == want


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, [1.0, 0.0, 0.0, 0.1], 1, 7), (4, [1.0, 0.0, 0.0, 0.1], 1, 7), (None, [0.0, 1.0, 0.0, 0.0], 1, 7), (2, [0.0, 0.0, 1.0, 0.0], 1, 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id int")
    got = sorted(map(str, ((x["vec_id"], x["n_links"], x["component_id"]) for x in embeddings.near_duplicates(table).collect())))
    assert got == sorted(map(str, [(None, 1, 4), (4, 1, 4), (None, 0, None), (2, 0, 2)]))


def test_a_vector_is_sent_to_few_tasks(spark, monkeypatch):
    """Vectors in all directions, which no grid of cells keeps apart, and near copies: what is dealt grows with the rows and the blocks, not with cells; all links are found."""
    g = np.random.default_rng(8)
    x = g.standard_normal((3000, 32))
    x[::30] = x[0] + 0.05 * g.standard_normal((100, 32))
    x[1::150] = x[1] + 0.2 * g.standard_normal((20, 32))
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, x[7].tolist(), 1), (5001, x[30].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    sent, plain = [], type(table).repartition

    def counted(self, *columns):
        sent.append(self.count())
        return plain(self, *columns)

    monkeypatch.setattr(type(table), "repartition", counted)
    unit = np.array([v for _, v, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    want = sorted((r[0], int(n) - 1) for r, n in zip(rows, linked.sum(1)))
    assert sum(n for _, n in want) > 8000
    for blocks, options in ((3, {}), (7, {"block_bytes": 4 * 32 * 500})):
        sent.clear()
        got = embeddings.near_duplicates(table, **options).collect()
        assert sorted((r["vec_id"], r["n_links"]) for r in got) == want
        assert {r["component_id"] for r in got if r["n_links"] >= 99} == {0}
        assert sent == [3000 * (blocks + 1) // 2]  # before: one row for each cell that a vector visits
