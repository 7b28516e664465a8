"""N-gram Jaccard join by PartEnum signatures.

A document's set holds hashes (64 bits) of its distinct word n-grams. Sets are
put into bands of sizes so narrow that a set only links within its band or the
next. For each band the Hamming distance that linked sets can have is known,
``k``. The hash domain is cut into ``first`` ranges, one of which holds at most
``errors`` of the ``k`` differences, and that range into ``second`` cells; a
signature is the projection of a set onto all but ``errors`` of the cells, for
every such subset of cells. Linked sets share at least one signature. A
projection without elements says little and would be shared by very many sets.
So there are spare ranges, of which linked sets then agree on ``spare + 1`` or more, and a
set that lacks elements in more ranges than the spares signs every ``spare + 1``
such ranges together.

Most documents have no near copy, and a prefix filter spares them the
signatures: of a set's smallest hashes (a fixed share of them), so many must also
be among the smallest of a linked set that a set where fewer occur anywhere
else links with nothing. The filter is exact.

Equal sets count once, under the hash of the set. Sets that share a signature
form a group; groups with the same members count once, and groups that overlap
form a cluster. A cluster is compared in blocks: each task gets two blocks of
sets, counts all their common elements as a product of matrices, and hands on
only edges that join linked sets, never pairs. Of clusters beyond ``cluster_rows`` first the
member that meets most others in a group is compared with all the rest, which
brings a large group of near copies together in linear work; groups that lie in one
component need nothing more. So no link between different
texts is lost. A comparison is exact, on the sets of both texts.

Defined cases: null texts and texts without words have the empty set and link
with nothing; texts with fewer words than ``n`` have their whole sequence as the
one element; repeated rows and ids each give a row (repeated texts link);
a null id gives its row but is never a component's id unless alone; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import WordHasher, cut, discard, mixed, raw_bytes, release_worker, store
from lateflow.llm.components import components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler(WordHasher):
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n
        self.weight = mixed(np.arange(1, n + 1, dtype=np.uint64) * _A) | np.uint64(1)  # of the words of a shingle

    def hashes(self, text: bytes) -> np.ndarray:
        x = self.words(text.lower())  # of bytes: A-Z only
        if not len(x):
            return x
        width = min(self.n, len(x))
        out = np.full(len(x) - width + 1, width, np.uint64)
        for i in range(width):
            out += x[i : i + len(out)] * self.weight[i]
        out = np.sort(mixed(out))
        return out[np.append(True, out[1:] != out[:-1])]


def fingerprint(h: np.ndarray) -> int:
    """A set's own hash, as a signed 64-bit number."""
    return int(mixed(np.array([mixed(h).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands and signature parameters for similarity at least ``part / whole``."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        self.upper = [0]  # largest size of each band; band 0 is empty
        self.plans: dict[int, tuple] = {}
        self.edges: dict[int, np.ndarray] = {}

    def _extend(self) -> None:
        low = self.upper[-1] + 1
        self.upper.append(low * self.whole // self.part)

    def band(self, size: int) -> int:
        while self.upper[-1] < size:
            self._extend()
        return bisect_left(self.upper, size)

    def plan(self, index: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int]:
        """(ranges, cells in a range, subsets of cells, spare ranges) for pairs whose larger set lies in band ``index``."""
        if index not in self.plans:
            while index >= len(self.upper):
                self._extend()
            self.plans[index] = self._plan(index)
        return self.plans[index]

    def _plan(self, index: int) -> tuple[int, int, tuple[tuple[int, ...], ...], int]:
        k = (self.whole - self.part) * 2 * self.upper[index] // (self.whole + self.part)
        if k == 0:
            return 1, 1, ((0,),), 0
        if k <= 3:
            errors, second = k, {1: 4, 2: 6, 3: 7}[k]
        else:
            errors, second = (3, 7) if k <= 12 else (2, 5)
        spare = 2 if k > 12 else 0
        return k // (errors + 1) + 1 + spare, second, tuple(combinations(range(second), second - errors)), spare

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """All signatures of a set given as sorted hashes."""
        own = self.band(len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _B), dtype=np.uint64)])
        out = []
        for index in (own, own + 1):
            first, second, subsets, spare = self.plan(index)
            cells = first * second
            if cells not in self.edges:
                self.edges[cells] = np.array([(i << 64) // cells for i in range(1, cells)], np.uint64)
            at = np.concatenate([[0], np.searchsorted(h, self.edges[cells]), [len(h)]])
            sums = (total[at[1:]] - total[at[:-1]]).reshape(first, second)
            full = np.diff(at).reshape(first, second) > 0
            made, some = [], []
            for number, subset in enumerate(subsets):
                value = np.zeros(first, np.uint64)
                for c in subset:
                    value += mixed(sums[:, c] + np.uint64(c + 1))
                made.append(mixed(value + np.arange(first, dtype=np.uint64) * _A + np.uint64((index * 1009 + number) * int(_B) & (1 << 64) - 1)))
                some.append(full[:, subset].any(1))
            made, some = np.stack(made, 1), np.stack(some, 1)
            out.append(made[some])
            if (~some.all(1)).sum() > spare:
                # any spare + 1 ranges that lack elements, with a subset that lacks them in each
                lacking = [(int(r), int(v)) for r, v in zip(np.nonzero(~some)[0], made[~some])]
                together = [sum(v for _, v in c) & (1 << 64) - 1 for c in combinations(lacking, spare + 1) if len({r for r, _ in c}) == spare + 1]
                out.append(mixed(np.array(together, np.uint64) ^ _A))
        return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def jaccard_components(docs: DataFrame, n: int = 5, part: int = 4, whole: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row; links at a similarity of ``part / whole`` or more."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).withColumn("_key", F.xxhash64("_text"))
    seen = measure(docs, n, part, whole)
    rows = seen.where("shared is null").select("_id", "_key", "n_shingles", "node")
    active = prefix_filter(seen, part, whole)
    sets = _texts(docs, rows, active, n)
    members = signature_groups(sets, n, part, whole)
    links = resolve(members, sets, n, part, whole)

    joined = rows.join(links, rows["node"] == links["id"], "left").select("_id", "n_shingles", F.coalesce("root", "node").alias("_root"))
    smallest = joined.where("_root is not null").groupBy("_root").agg(F.min("_id").alias("component_id"))
    return joined.join(smallest, "_root", "left").select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))


def _bits(df: DataFrame) -> int:
    """Enough buckets of the hash space for every shuffle partition; a task sends a row for each bucket at most."""
    return max(6, math.ceil(math.log2(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _pack(values: np.ndarray, node: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted values and their nodes, one row for each bucket of the hash space."""
    order = np.argsort(values)
    values, node = values[order], node[order]
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    packed = [values[p:q].tobytes() + node[p:q].tobytes() for p, q in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order of their values (a pair that several tasks have met counts once), and begin and size of each value's run of two or more."""
    pairs = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in parts]
    values, node = np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]).view(np.int64)
    order = np.lexsort((node, values))
    values, node = values[order], node[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (node[1:] != node[:-1])
    values, node = values[new], node[new]
    at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    size = np.diff(at)
    return node, at[:-1][size > 1], size[size > 1]


def _emit(texts: Iterator[bytes], n: int, make, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed values that ``make`` gives for each distinct set of a task's texts."""
    release_worker()
    shingler, seen, held, count = Shingler(n), set(), [], 0

    def flush() -> pa.RecordBatch:
        values = np.concatenate([v for v, _ in held])
        node = np.repeat(np.array([f for _, f in held], np.int64), [len(v) for v, _ in held])
        held.clear()
        return _pack(values, node, bits)

    for text in texts:
        h = shingler.hashes(text)
        if not len(h):
            continue
        node = fingerprint(h)
        if node in seen:
            continue
        if len(seen) >= 200_000:
            seen.clear()
        seen.add(node)
        held.append((make(h), node))
        count += len(held[-1][0])
        if count >= 1_000_000:
            yield flush()
            count = 0
    if held:
        yield flush()


def _by_bucket(batches: Iterable[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
    """``finish`` of all rows of each bucket; rows come sorted by bucket."""
    current, parts = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != current and parts:
                yield finish(parts)
                parts = []
            current = bucket
            parts.append(packed)
    if parts:
        yield finish(parts)


#: Share of a set's smallest hashes that are counted beyond those that a linked set may lack.
SPARE = 0.06


def measure(docs: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """All that one pass over the texts of ``docs (_id, _text, _key)`` tells, as one table: a row per document (``_id, _key, n_shingles, node``; ``shared``
    null), and rows ``node, shared``: how many of a set's smallest hashes occur among those of other sets.

    The hashes travel packed by bucket of the hash space, and the documents' rows with them, so texts are cut into shingles once.
    """
    bits, share = _bits(docs), (whole - part) / whole + SPARE
    kind = docs.schema["_id"].dataType.simpleString()
    names = ["bucket", "packed", "_id", "_key", "n_shingles", "node"]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        shingler, seen, held, count = Shingler(n), set(), [], 0

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            values = np.concatenate([v for v, _ in held])
            rows = _pack(values, np.repeat(np.array([f for _, f in held], np.int64), [len(v) for v, _ in held]), bits)
            held.clear()
            none = [pa.nulls(rows.num_rows, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*rows.columns, *none], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                size, node = [], []
                for text in raw_bytes(some.column(1)):
                    h = shingler.hashes(text)
                    size.append(len(h))
                    node.append(fingerprint(h) if len(h) else None)
                    if not len(h) or node[-1] in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(node[-1])
                    held.append((h[: int(len(h) * share) + 2], node[-1]))
                    count += len(held[-1][0])
                    if count >= 1_000_000:
                        yield flush(id_type)
                        count = 0
                spread = pa.array((np.arange(len(size)) + at) % (1 << bits), pa.int32())
                columns = [spread, pa.nulls(len(size), pa.binary()), some.column(0), some.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
        if held:
            yield flush(id_type)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            node, begin, size = _unpack(parts)
            shared = np.zeros(len(node) + 1, np.int64)
            np.add.at(shared, begin, 1)
            np.add.at(shared, begin + size, -1)
            return np.unique(node[np.cumsum(shared)[:-1] > 0], return_counts=True)

        def rows(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            own, times = found
            columns = [pa.nulls(len(own), id_type), *[pa.nulls(len(own), pa.int64())] * 2, pa.array(own, pa.int64()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["_id", "_key", "n_shingles", "node", "shared"])

        release_worker()
        current, parts, id_type = None, [], pa.int64()
        for batch in batches:
            id_type, of_document = batch.column(2).type, batch.column(1).is_null()
            own = batch.filter(of_document)
            yield pa.RecordBatch.from_arrays([*own.columns[2:], pa.nulls(own.num_rows, pa.int64())], ["_id", "_key", "n_shingles", "node", "shared"])
            own = batch.filter(pc.invert(of_document))
            for bucket, packed in zip(own.column(0).to_pylist(), own.column(1).to_pylist()):
                if bucket != current and parts:
                    yield rows(finish(parts))
                    parts = []
                current = bucket
                parts.append(packed)
        if parts:
            yield rows(finish(parts))

    signed = docs.select("_id", "_text", "_key").mapInArrow(sign, f"bucket int, packed binary, _id {kind}, _key long, n_shingles long, node long")
    dealt = signed.repartition("bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(count, f"_id {kind}, _key long, n_shingles long, node long, shared long"))


def prefix_filter(seen: DataFrame, part: int, whole: int) -> DataFrame:
    """``(node)`` of the sets that may link: enough of their smallest hashes occur among those of other sets."""
    counts = seen.where("shared is not null").groupBy("node").agg(F.sum("shared").alias("shared"))
    sizes = seen.where("shared is null and node is not null").select("node", "n_shingles").distinct()
    # a linked set has at least part / whole of this one's elements, and of its prefix all but (whole - part) / whole of its elements are in this one
    needed = F.floor(F.col("n_shingles") * (part / whole * SPARE) - 1e-9) + 1
    return cut(counts.join(sizes, "node").where(F.col("shared") >= needed).select("node"))


def signature_groups(sets: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """``(gid, node, met)``: sets that share a signature, groups with the same members once; ``met`` is the group's size.

    Signatures travel packed: tasks sort them and send one row for each bucket of the
    signature space. A set has very many signatures, so even a
    group of a third of all documents is a small part of any bucket.
    """
    bits = _bits(sets)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, bands = zstandard.ZstdDecompressor(), Bands(part, whole)
        yield from _emit((expand.decompress(p) for b in batches for p in b.column(0).to_pylist()), n, bands.signatures, bits)

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()

        def finish(parts: list[bytes]) -> pa.RecordBatch:
            node, begin, size = _unpack(parts)
            gid, member, met = [], [], []
            for p, m in zip(begin.tolist(), size.tolist()):
                own = node[p : p + m]
                key = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
                if key in known:
                    continue
                if len(known) >= 200_000:
                    known.clear()
                known.add(key)
                gid.append(np.full(m, int.from_bytes(key, "little", signed=True)))
                member.append(own)
                met.append(np.full(m, m))
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or none), pa.int64()) for c in (gid, member, met)], ["gid", "node", "met"])

        yield from _by_bucket(batches, finish)

    packed = sets.select("packed").mapInArrow(sign, "bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    return cut(packed.mapInArrow(group, "gid long, node long, met long").distinct())


def _texts(docs: DataFrame, rows: DataFrame, active: DataFrame, n: int) -> DataFrame:
    """``(node, packed)``: one text of every active set, compressed."""
    keys = rows.join(active, "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, done = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            key, packed = [], []
            for own, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                if own not in done:
                    if len(done) >= 200_000:
                        done.clear()
                    done.add(own)
                    key.append(own)
                    packed.append(squeeze.compress(text))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(packed, pa.binary())], ["_key", "packed"])

    def right(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text does have the set of the node, should two texts ever share a key."""
        shingler, expand = Shingler(n), zstandard.ZstdDecompressor()
        for batch in batches:
            yield batch.filter(pa.array([fingerprint(shingler.hashes(expand.decompress(p))) == f for f, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    packed = docs.select("_key", "_text").mapInArrow(pack, "_key long, packed binary")
    found = packed.join(keys, "_key").select("node", "packed").mapInArrow(right, "node long, packed binary")
    return cut(found.groupBy("node").agg(F.first("packed").alias("packed")))


def resolve(members: DataFrame, sets: DataFrame, n: int, part: int, whole: int, cluster_rows: int = 8_192, rounds: int = 8) -> DataFrame:
    """``(id, root)`` of linked sets, from groups that share a signature and a text for each set."""
    weight = members.groupBy("node").agg(F.sum("met").alias("weight"))
    members = store(members.join(weight, "node").select("gid", "node", "weight"))
    roots = store(members.select(F.col("node").alias("id"), F.col("node").alias("root")).distinct())
    for turn in range(rounds + 1):
        placed = members.join(roots, members["node"] == roots["id"]).select("gid", "node", "weight", "root")
        open_groups = placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first"), F.max(F.struct("weight", "node"))["node"].alias("center")).where("lo <> hi")
        state = store(placed.join(open_groups.select("gid", "first", "center"), "gid"))
        discard(members)
        clusters = components(state.select(F.col("node").alias("a"), F.col("first").alias("b")))
        sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
        largest = sizes.agg(F.max("m")).first()[0]
        if largest is None:  # no group is open
            found = None
        elif largest <= cluster_rows or turn == rounds:
            found = compare_blocks(clusters.select(F.col("id").alias("node"), F.col("root").alias("cluster")), sizes.select(F.col("root").alias("cluster"), "m"), roots, sets, n, part, whole)
        else:
            center = state.where("node = center").select("gid", F.col("root").alias("center_root"))
            found = verify(state.join(center, "gid").where("root <> center_root").select("center", "node").distinct(), sets, n, part, whole)
        discard(clusters)
        if found is not None:
            ends = found.join(roots.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b")
            merged = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            before, roots = roots, store(roots.join(merged.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
            for old in (before, found, merged):
                discard(old)
        if found is None or largest <= cluster_rows:
            break
        members = store(state.where("node <> center").select("gid", "node", "weight"))
        discard(state)
    discard(state)
    return roots


def compare_blocks(clusters: DataFrame, sizes: DataFrame, roots: DataFrame, sets: DataFrame, n: int, part: int, whole: int, block_rows: int = 400) -> DataFrame:
    """``(a, b)``: edges that join all linked sets of each cluster ``(node, cluster)``."""
    blocks = F.ceil(F.col("m") / block_rows).cast("int")
    nodes = (
        clusters.join(sizes, "cluster")
        .withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        .join(roots.withColumnRenamed("id", "node"), "node")
        .join(sets, "node")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = nodes.select("cluster", "block", "node", "root", "packed", other).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "packed"
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, expand = Shingler(n), zstandard.ZstdDecompressor()

        def finish(key: tuple, held: list[tuple]) -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            hashes = [shingler.hashes(expand.decompress(p)) for _, _, _, p in held]
            block = np.array([b for b, _, _, _ in held])
            first, second = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            linked_ = linked_pairs([hashes[i] for i in first], [hashes[i] for i in second], part, whole)
            parent = list(range(len(held)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            by_root: dict[int, int] = {}
            for i, (_, _, r, _) in enumerate(held):  # what is joined already needs no edge
                parent[i] = by_root.setdefault(r, i)
            out = []
            for i, j in linked_:
                x, y = root(int(first[i])), root(int(second[j]))
                if x != y:
                    parent[x] = y
                    out.append((held[first[i]][1], held[second[j]][1]))
            return out

        current, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for cluster, lo, hi, block, node, r, packed in zip(*(batch.column(c).to_pylist() for c in ("cluster", "lo", "hi", "block", "node", "root", "packed"))):
                if (cluster, lo, hi) != current:
                    out += finish(current, held)
                    current, held = (cluster, lo, hi), []
                held.append((block, node, r, packed))
            yield _edges(out)
        yield _edges(finish(current, held))

    dealt = rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "block")
    return store(dealt.mapInArrow(compare, "a long, b long"))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], ["a", "b"])


def linked_pairs(first: list[np.ndarray], second: list[np.ndarray], part: int, whole: int, columns: int = 8_192) -> list[list[int]]:
    """Indices of linked sets of two lists; common elements are counted as products of 0/1 matrices, some columns at a time."""
    a, b = np.concatenate([*first, np.zeros(0, np.uint64)]), np.concatenate([*second, np.zeros(0, np.uint64)])
    both = np.intersect1d(a, b)  # other elements are common to no pair
    size_a, size_b = np.array([len(h) for h in first]), np.array([len(h) for h in second])
    row_a, row_b = np.repeat(np.arange(len(first)), size_a), np.repeat(np.arange(len(second)), size_b)
    common = np.zeros((len(first), len(second)), np.float32)
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    in_a = at_a < len(both)
    in_a[in_a] = both[at_a[in_a]] == a[in_a]
    in_b = at_b < len(both)
    in_b[in_b] = both[at_b[in_b]] == b[in_b]
    for begin in range(0, len(both), columns):
        x, y = (np.zeros((len(s), min(columns, len(both) - begin)), np.float32) for s in (first, second))
        for matrix, row, at, inside in ((x, row_a, at_a, in_a), (y, row_b, at_b, in_b)):
            here = inside & (at >= begin) & (at < begin + columns)
            matrix[row[here], at[here] - begin] = 1
        common += x @ y.T
    count = common.astype(np.int64)  # below 2 ** 24 common elements these sums are exact
    return np.argwhere(whole * count >= part * (size_a[:, None] + size_b[None] - count)).tolist()


def verify(pairs: DataFrame, sets: DataFrame, n: int, part: int, whole: int, salt_rows: int = 2_000) -> DataFrame:
    """``(a, b)``: the linked ones of ``pairs (center, node)``.

    A centre's text is read once and its partners stream past it; centres with
    very many partners are spread over several tasks.
    """
    pairs = store(pairs)
    share = pairs.groupBy("center").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    salted = pairs.join(share, "center").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    partners = salted.join(sets, "node").select("center", "salt", F.lit(1).alias("role"), "node", "packed")
    centers = share.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("node", "center"), "center")
    rows = partners.unionByName(centers.select("center", "salt", F.lit(0).alias("role"), F.col("center").alias("node"), "packed"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, expand = Shingler(n), zstandard.ZstdDecompressor()
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for center, role, node, packed in zip(*(batch.column(c).to_pylist() for c in ("center", "role", "node", "packed"))):
                h = shingler.hashes(expand.decompress(packed))
                if not role:
                    own = h
                elif linked(own, h, part, whole):
                    out.append((center, node))
            yield _edges(out)

    dealt = rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
    found = store(dealt.mapInArrow(compare, "a long, b long"))
    discard(pairs)
    return found
