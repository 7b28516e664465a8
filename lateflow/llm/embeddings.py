"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are halved; each half has a codebook of its own (k-means on a
bounded sample), and the product of both is a grid of cells. Every vector lies
in one cell, at some angle to the cell's axis (its two codewords side by side). A query passes
over the vectors whose angle to their axis is smaller than its own by more than the angle of the threshold: they cannot be
neighbours. With a target recall of 1 that is the only end, and every link is found; a lower target ends visits earlier, in
multi-sequence order (nearest sum of both halves' distances first), after a number of cells calibrated on
the sample for neighbours just at the threshold. What a query meets is first compared by its leading principal components and the length of
what is left, which bound the cosine from above, then verified by cosine in double precision.

The vectors of a label are dealt into an odd number of blocks. A block is held by one task and met by the vectors of half
of the other blocks, so each pair is compared once, a vector is sent to (blocks + 1) / 2 tasks, and cells exist only inside a
task. A link found counts for both.

Equal vectors of a label count once, with their number. Tasks report, for each
visitor and each vector held, the number of its links, and edges that join linked vectors to one of
them: never all pairs.

Defined cases: null or empty vectors, zero vectors, vectors with null or
non-finite components and vectors without a label link with nothing;
vectors of different lengths never link; a null id is no one's smallest id, and its own component only where it has no other; repeated rows and ids each give a row
(equal vectors of a label link); an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import cut, discard, hash_sample, load, share, store
from lateflow.llm.components import components


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    r = np.random.default_rng(seed)
    centers = x[[r.integers(len(x))]]
    nearest = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k and nearest.sum() > 0:  # k-means++
        new = x[r.choice(len(x), p=nearest / nearest.sum())]
        centers = np.vstack([centers, new])
        nearest = np.minimum(nearest, ((x - new) ** 2).sum(1))
    for _ in range(rounds):
        own = _distances(x, centers).argmin(1)
        for j in range(len(centers)):
            if (own == j).any():
                centers[j] = x[own == j].mean(0)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)[None], 0)


def multi_sequence(near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of codewords in rising order of the sum of their distances to a query's halves."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen = [(float(near[a[0]] + far[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(near[a[p]] + far[b[q]]), p, q))


class MultiIndex:
    """Codebooks of both halves for unit vectors of one length, and their principal directions."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, target: float, queries: int = 512):
        self.half = sample.shape[1] // 2
        self.threshold = threshold
        self.angle = math.acos(max(-1.0, min(1.0, threshold)))
        self.books = [kmeans(self._part(sample, s), codewords) for s in (0, 1)]
        self.visits = self._calibrate(sample[:queries], threshold, target) if target < 1 else len(self.books[0]) * len(self.books[1])
        self.every = self.visits >= len(self.books[0]) * len(self.books[1])
        length = np.sqrt((self.books[0] ** 2).sum(1)[:, None] + (self.books[1] ** 2).sum(1)[None]).ravel()
        self.length = np.maximum(length, 1e-12)  # of the cells' axes
        self.turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        self.leading = self._leading(sample[: 4 * queries])

    def _part(self, x: np.ndarray, side: int) -> np.ndarray:
        return x[:, : self.half] if side == 0 else x[:, self.half :]

    def _calibrate(self, sample: np.ndarray, threshold: float, target: float) -> int:
        """Cells to visit so that neighbours at the threshold, in random directions, are met with the target recall."""
        r = np.random.default_rng(3)
        aside = r.standard_normal(sample.shape)
        aside -= (aside * sample).sum(1, keepdims=True) * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        cells = self.cells(threshold * sample + np.sqrt(max(0, 1 - threshold**2)) * aside)
        distances = [_distances(self._part(sample, s), self.books[s]) for s in (0, 1)]
        ranks = []
        for i, cell in enumerate(cells):
            total = distances[0][i][:, None] + distances[1][i][None]
            ranks.append(int((total < total.flat[cell]).sum()) + 1)
        return int(np.quantile(ranks, target, method="higher")) if ranks else 1

    def _leading(self, sample: np.ndarray) -> int:
        """Principal components that let through few pairs of the sample that do not link."""
        apart = sample @ sample.T < self.threshold
        for n in range(7, sample.shape[1] - 1, 8):
            short = self.shorten(sample, n)
            if ((short @ short.T >= self.threshold) & apart).sum() <= 2e-5 * len(sample) ** 2:
                return n
        return sample.shape[1]

    def shorten(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        """Leading components and the length of what is left: unit vectors whose product is the cosine or more."""
        lead = x @ self.turn[:, : self.leading if n is None else n]
        rest = np.sqrt(np.maximum(1 - (lead**2).sum(1, keepdims=True), 0))
        return np.hstack([lead, rest]).astype(np.float32)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (_distances(self._part(x, s), self.books[s]).argmin(1) for s in (0, 1))
        return a * len(self.books[1]) + b

    def along(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each half, products of the codewords (rows) with the vectors: their sum is a vector's product with a cell's axis."""
        return [np.ascontiguousarray((self.books[s] @ self._part(x, s).T).astype(np.float32)) for s in (0, 1)]

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Distances of the halves to the codewords, and their sum where the visit of each vector ends; None where it never does."""
        if self.every:
            return None
        near, far = (_distances(self._part(x, s), self.books[s]) for s in (0, 1))
        last = []
        for i in range(len(x)):
            for n, (a, b) in enumerate(multi_sequence(near[i], far[i]), 1):
                if n == self.visits:
                    break
            last.append(near[i][a] + far[i][b])
        return near.T, far.T, np.array(last)


TILE = 64  # vectors of a cell that are met at once


class Block:
    """Vectors that a task holds, by cell and angle to its axis, and the links found so far."""

    def __init__(self, index: MultiIndex, raw: np.ndarray, node: np.ndarray, copies: np.ndarray):
        self.index, n = index, len(raw)
        cell, cosine = np.zeros(n, np.int64), np.ones(n)
        self.gridded = n > 4 * TILE
        if self.gridded:
            for at in range(0, n, 8192):
                x = _normal(raw[at : at + 8192])
                some = cell[at : at + 8192] = index.cells(x)
                a, b = np.divmod(some, len(index.books[1]))
                axis = np.hstack([index.books[0][a], index.books[1][b]])
                cosine[at : at + 8192] = (x * axis).sum(1) / index.length[some]
        order = np.lexsort((cosine, cell))  # the widest angles of a cell first
        self.raw, self.node, self.copies = raw[order], node[order], copies[order]
        cell, cosine = cell[order], cosine[order]
        self.short = np.vstack([index.shorten(_normal(self.raw[at : at + 8192])) for at in range(0, n, 8192)])
        self.parent, self.got = np.arange(n), np.zeros(n, np.int64)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(starts, n))
        self.tiles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # by first codeword: second one, first and last place, least product
        first = np.concatenate([np.arange(s, s + k, TILE) for s, k in zip(starts, sizes)])
        last = np.minimum(first + TILE, np.repeat(starts + sizes, -(-sizes // TILE)))
        widest = np.minimum(np.arccos(np.clip(cosine[first], -1, 1)) + index.angle, math.pi)
        least = (np.cos(widest) * index.length[cell[first]] - 1e-4).astype(np.float32)
        a, b = np.divmod(cell[first], len(index.books[1]))
        for k in np.unique(a).tolist():
            own = a == k
            self.tiles[k] = (b[own], first[own], last[own], least[own])

    def roots(self, which: np.ndarray) -> np.ndarray:
        out = self.parent[which]
        while (self.parent[out] != out).any():
            out = self.parent[out]
        self.parent[which] = out
        return out

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the vectors of ``a`` with those of ``b``, place by place."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def meet(self, raw: np.ndarray, copies: np.ndarray, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Number of links of each visitor, and one vector linked with it (-1: none). ``own``: the visitors are the vectors held from this place on; they meet those after them."""
        index, x = self.index, _normal(raw)
        short, along = index.shorten(x), index.along(x) if self.gridded else None
        ends = index.ends(x) if self.gridded else None
        links, linked = np.zeros(len(x), np.int64), np.full(len(x), -1)
        place = own + np.arange(len(x))
        everyone = np.arange(len(x))
        for k, (second, first, last, least) in self.tiles.items():
            if own >= 0:
                some = last > own + 1
                second, first, last, least = second[some], first[some], last[some], least[some]
            if self.gridded and len(second):
                codes, back = np.unique(second, return_inverse=True)
                total = along[1][codes] + along[0][k][None]
            for t in range(len(second)):
                who = everyone
                if self.gridded:
                    near = total[back[t]] >= least[t]
                    if ends:
                        near &= ends[0][k] + ends[1][second[t]] <= ends[2]
                    who = np.flatnonzero(near)
                p, q = int(first[t]), int(last[t])
                if own >= 0:
                    who = who[: np.searchsorted(who, q - 1 - own)]
                if not len(who):
                    continue
                maybe = short[who] @ self.short[p:q].T >= index.threshold - 1e-5
                if own >= 0 and place[who[-1]] >= p:
                    maybe &= place[who][:, None] < np.arange(p, q)[None]
                if not maybe.any():
                    continue
                rows, columns = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                who, held = who[rows], p + columns
                hit = (x[who] @ _normal(self.raw[held]).T >= index.threshold) & maybe[np.ix_(rows, columns)]
                rows = np.flatnonzero(hit.any(1))
                if not len(rows):
                    continue
                who, hit = who[rows], hit[rows]
                self.got[held] += copies[who] @ hit
                links[who] += hit @ self.copies[held]
                one = np.where(linked[who] >= 0, linked[who], held[hit.argmax(1)])
                one = place[who] if own >= 0 else one
                linked[who] = one
                root = self.roots(held)
                i, j = np.nonzero(hit & (root[None] != self.roots(one)[:, None]))
                self.unite(one[i], held[j])
        if own >= 0:
            self.got[own : own + len(x)] += links
        return links, linked

    def settle(self) -> None:
        """The vectors held meet each other."""
        for at in range(0, len(self.raw), 8192):
            self.meet(self.raw[at : at + 8192], self.copies[at : at + 8192], at)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the vectors held, and edges among those that are joined."""
        root = self.roots(np.arange(len(self.raw)))
        told = np.flatnonzero((self.got > 0) | (root != np.arange(len(root))))
        return self.node[told], self.node[root[told]], self.got[told]


def _normal(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(batch: pa.ListArray, size: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    codewords: int | None = None,
    target_recall: float = 1.0,
    sample_rows: int = 8_192,
    part_rows: int = 2_048,
    block_bytes: int = 128 << 20,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``. A label of more than ``part_rows`` vectors has three blocks, or as many as keep one
    within ``block_bytes`` (as float). Without ``codewords`` a half has 4 to 96, so that a cell holds about 96 vectors of a block."""
    spark = vectors.sparkSession
    v = F.col("_v")
    clean = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & F.col("_l").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_l"))
    rows = rows.withColumn("node", F.when(clean, F.xxhash64("_l", F.size("_v"), "_v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("_l").alias("_l"), F.first("_v").alias("_v"))
    nodes = store(nodes.withColumn("_n", F.size("_v")))
    own = rows.select("_id", "node")
    lengths = sorted((r[0], r[1]) for r in nodes.groupBy("_n").count().collect())  # one for each kind of vector

    found = None
    for size, _ in lengths:
        part = nodes.where(F.col("_n") == size)
        within = max(1, block_bytes // (4 * size))  # rows
        blocks = F.greatest(F.lit(3), 2 * F.floor(F.ceil(F.col("rows") / within) / 2) + 1).cast("int")
        large = part.groupBy("_l").agg(F.count("*").alias("rows")).where(F.col("rows") > part_rows).select("_l", "rows", blocks.alias("blocks"))
        most = large.agg(F.max(F.col("rows") / F.col("blocks"))).first()[0] or part_rows
        sample = hash_sample(part, sample_rows, "node").select("_v").collect()
        table = pa.array([r[0] for r in sample], pa.list_(pa.float64()))
        index = MultiIndex(_normal(_rows(table, size)), codewords or min(96, max(4, math.isqrt(int(most) // 96))), threshold, target_recall)
        met = _meet(part, share(spark, index), size, large.select("_l", "blocks"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        discard(nodes)
        return own.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found, copies = cut(found), cut(nodes.select("node", "copies"))
    discard(nodes)
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    totals = (
        copies.join(counts, "node", "left")
        .join(roots, F.col("node") == F.col("id"), "left")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    joined = own.join(totals, "node", "left")
    smallest = joined.where("root is not null").groupBy("root").agg(F.min("_id").alias("component_id"))
    return joined.join(smallest, "root", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(True)).alias("kept"),
    )


def _meet(nodes: DataFrame, shared, size: int, large: DataFrame) -> DataFrame:
    """``(a, b, links)``: per block and visitor or vector held the number of vectors linked, and edges that join what is linked. ``large``: labels of more than one
    block, with their (odd) number; few, as each has many rows."""
    blocks = nodes.join(F.broadcast(large), "_l", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = blocks.withColumn("home", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    sent = home.withColumn("role", F.explode(F.sequence(F.lit(0), F.expr("cast(blocks div 2 as int)"))))  # 0: to be held, others: so many blocks further on
    dealt = sent.select("_l", F.pmod(F.col("home") + F.col("role"), F.col("blocks")).alias("block"), F.least("role", F.lit(1)).alias("role"), "node", "copies", "_v")
    dealt = dealt.repartition("_l", "block").sortWithinPartitions("_l", "block", "role")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, current, parts, block = load(shared), None, [], None

        def held() -> Block | None:
            """What the rows read so far hold, their own links found."""
            nonlocal parts, block
            if parts:
                raw, node, copies = (np.concatenate(x) for x in zip(*parts))
                parts, block = [], Block(index, raw, node, copies)
                block.settle()
            return block

        def told(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_l", "block", "role"))))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                some = batch.slice(at, end - at)
                raw, node, copies = _rows(some.column("_v"), size), some.column("node").to_numpy(), some.column("copies").to_numpy()
                if keys[at][:2] != current:
                    if last := held():
                        yield told(*last.found())
                    current, block = keys[at][:2], None
                if not keys[at][2]:
                    parts.append((raw.copy(), node.copy(), copies.copy()))
                elif held():
                    links, linked = block.meet(raw, copies)
                    some = np.flatnonzero(links)
                    yield told(node[some], block.node[linked[some]], links[some])
                at = end
        if last := held():
            yield told(*last.found())

    return dealt.mapInArrow(compare, "a long, b long, links long")
