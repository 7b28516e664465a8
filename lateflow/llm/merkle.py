"""Merkle manifest of a dataset: one tree per group of rows, and a tree over the groups' roots.

Leaves are digests of rows. Each group's leaves ascend by id; while several
nodes remain, every ``RUN`` consecutive ones (a last run may be shorter) become
the digest of their run. The groups' roots, ordered by group (null first, bytewise),
form the tree of the whole dataset in the same way.

Postorder append log. Leaves are cut into aligned subtrees of ``BLOCK`` leaves.
A builder takes one subtree and appends every node to its log when it is complete:
leaves as they come, a parent right after its last child. In such a log the
place of a node follows from the sizes of the complete subtrees before it
(``position``), so proofs address siblings without an index and without reading the tree
again. Roots of builders are the leaves of the next tier; a tier has one row per
``BLOCK`` nodes of the tier below, so there are log(n) / log(BLOCK) tiers.

Rows are numbered within their group by a range sort and the counts of the
partitions before, so a group that holds a third of all rows is numbered and built by many
tasks. No task holds more than a block; the driver holds no digests.

Defined cases: a null field hashes as ``-``; a null group is a group of its own,
apart from the empty string; null ids come first; rows with one id are ordered by
digest, and equal rows are interchangeable; an empty text is a field of length 0;
very long texts are hashed by the JVM and never leave their task; an empty table gives
no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateflow.llm.common import cut

RUN = 8
HEIGHT = 3
BLOCK = RUN**HEIGHT
#: Rows of partition counts up to which they are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[bytes]) -> bytes:
    """Digest of a run: SHA-256 over the hexadecimal text of its nodes."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a subtree: ``HEIGHT`` where the tree has more blocks, else as many as its leaves need."""
    if n > BLOCK:
        return HEIGHT
    h = 0
    while RUN**h < n:
        h += 1
    return h


def position(level: int, j: int, leaves: int, top: int) -> int:
    """Place of node ``j`` of ``level`` in the log of a subtree with ``leaves`` leaves and ``top`` levels above them.

    Complete with it or before it: its own level's nodes up to it, all nodes below those, and the ancestors that ended before.
    """
    inside = sum(min((j + 1) * RUN ** (level - m), -(-leaves // RUN**m)) for m in range(level + 1))
    return inside + sum(j // RUN ** (m - level) for m in range(level + 1, top + 1)) - 1


class Builder:
    """Append log of one aligned subtree."""

    def __init__(self, top: int):
        self.top, self.log, self.open = top, [], [[] for _ in range(top + 1)]

    def append(self, node: bytes, level: int = 0) -> None:
        self.log.append(node)
        if level == self.top:
            return
        run = self.open[level]
        run.append(node)
        if len(run) == RUN:
            self.open[level] = []
            self.append(digest(run), level + 1)

    def close(self) -> bytes:
        """Complete the runs that are still open and return the log; its last node is the root."""
        for level in range(self.top):
            if run := self.open[level]:
                self.open[level] = []
                self.append(digest(run), level + 1)
        return b"".join(self.log)


def steps(log: bytes, leaf: int, leaves: int, top: int) -> list[bytes]:
    """The proof of one leaf within its subtree: for each level its place in the run, one byte, and the run's other nodes."""
    out, j = [], leaf
    for level in range(top):
        first, last = j - j % RUN, min(j - j % RUN + RUN, -(-leaves // RUN**level))
        at = [position(level, k, leaves, top) * 32 for k in range(first, last) if k != j]
        out.append(bytes([j - first]) + b"".join(log[a : a + 32] for a in at))
        j //= RUN
    return out


def siblings(path: list[bytes]) -> list[bytes]:
    """All siblings of a proof, level by level, left to right."""
    return [step[a : a + 32] for step in path for a in range(1, len(step), 32)]


def fold(node: bytes, path: list[bytes]) -> bytes:
    """The root that a node and the siblings of its proof lead to."""
    for step in path:
        others = [step[a : a + 32] for a in range(1, len(step), 32)]
        others.insert(step[0], node)
        node = digest(others)
    return node


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of fields one after the other: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``index`` (gapless from 0 within each tree, by ``order``) and ``n``, the tree's number of rows.

    Equal rows get a random last key, so that many copies of one row spread over partitions.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = cut(rows.orderBy(tree, *order, F.rand(5)).withColumns({"_part": F.spark_partition_id(), "_place": place}))
    parts = cut(tagged.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")))
    own = Window.partitionBy(tree)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    offsets = parts.select(tree, "_part", base, F.sum("_n").over(own).alias("n"))
    small = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # one row per partition and one more per tree
    joined = tagged.join(F.broadcast(offsets) if small else offsets, [tree, "_part"])
    return joined.withColumn("index", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def _build(payload: list[str], kinds: list[pa.DataType]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, builder, held, extra, count = None, None, [], [[] for _ in payload], [0]

        def end():
            if key is not None:
                held.append((*key, count[0], builder.close(), *extra))

        def out():
            columns = list(zip(*held))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *map(pa.list_, kinds)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["tree", "block", "n", "leaves", "log", *payload])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "node", *payload)))
            for tree, block, n, node, *more in rows:
                if (tree, block, n) != key:
                    end()
                    if len(held) >= 64:
                        yield out()
                    key, builder, count[0], extra = (tree, block, n), Builder(height(n)), 0, [[] for _ in payload]
                builder.append(node)
                count[0] += 1
                for column, x in zip(extra, more):
                    column.append(x)
        end()
        if held:
            yield out()

    return run


def tiers(rows: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The logs of all trees, tier by tier: ``tree, block, n, leaves, log`` and, in the first tier, the payload of its leaves as arrays.

    ``rows``: ``tree, index, n, node`` and the payload; ``n`` is the number of the tree's nodes in that tier.
    """
    most, out = rows.agg(F.max("n")).first()[0] or 0, []
    schema = T.StructType.fromDDL("tree string, block bigint, n bigint, leaves bigint, log binary")
    while not out or most > 1:
        names = payload if not out else []
        kinds = [rows.schema[c].dataType for c in names]
        full = T.StructType([*schema.fields, *(T.StructField(c, T.ArrayType(k)) for c, k in zip(names, kinds))])
        arrow = [pa.int64() if isinstance(k, T.LongType) else pa.int32() if isinstance(k, T.IntegerType) else pa.binary() if isinstance(k, T.BinaryType) else pa.string() for k in kinds]
        block = F.expr(f"index div {BLOCK}")
        dealt = rows.select("tree", block.alias("block"), "n", "index", "node", *names).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
        built = cut(dealt.drop("index").mapInArrow(_build(names, arrow), full))
        out.append(built)
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        rows = built.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("index"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), root_of("log").alias("node"))
    return out


def root_of(log: str) -> Column:
    return F.substring(log, -32, 32)


def _descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a block's leaves: its own steps, then the path of its root."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    for batch in batches:
        for tree, block, n, leaves, log, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
            own = [steps(log, i, leaves, height(n)) + path for i in range(leaves)]
            columns = [[tree] * leaves, [block * BLOCK + i for i in range(leaves)], own, [subroot] * leaves, [root] * leaves]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "block", "path", "subroot", "root"])


def block_paths(built: list[DataFrame], above: DataFrame, upper: bool) -> DataFrame:
    """The first tier's logs with ``path`` (from each block's root up), ``subroot`` and ``root``.

    ``above``: ``tree, path, root`` of every tree's own root; where ``upper`` the trees' roots are the whole dataset's.
    """
    root = F.col("root") if not upper else root_of("log")
    paths = None
    for t in range(len(built) - 1, -1, -1):
        ends = built[t].where(F.col("n") <= BLOCK).select("tree", "block", root_of("log").alias("subroot"), "log")
        ends = ends.join(above, "tree").select("tree", "block", "path", "subroot", root.alias("root"))
        paths = ends if paths is None else ends.unionByName(paths)
        logs = built[t].join(paths, ["tree", "block"])
        if t:
            read = logs.select("tree", "block", "n", "leaves", "log", "path", "subroot", "root")
            paths = read.mapInArrow(_descend, "tree string, block bigint, path array<binary>, subroot binary, root binary")
    return logs


def _prove(id_type: pa.DataType) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, leaves, log, ids, altered, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                top, rows = height(n), []
                for i, other in enumerate(altered):
                    full = steps(log, i, leaves, top) + path
                    at = position(0, i, leaves, top) * 32
                    leaf = log[at : at + 32]
                    folded = fold(leaf if other is None else other, full)
                    rows.append((leaf.hex(), subroot.hex(), root.hex(), digest(siblings(full)).hex(), folded.hex(), folded == root))
                columns = [pa.array(ids, id_type)] + [pa.array(c, pa.bool_() if k == 5 else pa.string()) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


class Manifest:
    """The logs of a dataset: ``groups`` by tier for the groups' trees, ``whole`` for the tree over their roots."""

    def __init__(self, groups: list[DataFrame], whole: list[DataFrame], id_col: str):
        self.groups, self.whole, self.id_col = groups, whole, id_col

    def logs(self) -> DataFrame:
        """Every log: ``part`` (groups or whole), ``tier``, ``tree`` (the group after a ``+``, empty for null), ``block``, ``leaves``, ``log``."""
        out = None
        for part, built in (("groups", self.groups), ("whole", self.whole)):
            for t, df in enumerate(built):
                own = df.select(F.lit(part).alias("part"), F.lit(t).alias("tier"), "tree", "block", "leaves", "log")
                out = own if out is None else out.unionByName(own)
        return out

    def proofs(self) -> DataFrame:
        """Per row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of all siblings), ``folded_root`` (from the altered
        leaf where there is one, else the leaf, and the siblings) and ``verified`` (it equals the root)."""
        top = block_paths(self.whole, self.whole[0].select("tree", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("root")).distinct(), upper=True)
        ends = top.select("block", "n", "leaves", "log", "path", "root", "names")
        above = ends.mapInArrow(_name_paths, "tree string, path array<binary>, root binary")
        rows = block_paths(self.groups, above, upper=False)
        kind = self.groups[0].schema["ids"].dataType.elementType
        arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
        schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
        proven = rows.select("n", "leaves", "log", "ids", "altered", "path", "subroot", "root").mapInArrow(_prove(arrow), schema)
        return proven.withColumnRenamed("id", self.id_col)


def _name_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, n, leaves, log, path, root, names in zip(*(c.to_pylist() for c in batch.columns)):
            own = [steps(log, i, leaves, height(n)) + path for i in range(leaves)]
            columns = [pa.array(names, pa.string()), pa.array(own, pa.list_(pa.binary())), pa.array([root] * leaves, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "path", "root"])


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    altered: dict[str, Column] | None = None,
    where: Column | None = None,
) -> Manifest:
    """Build the logs of ``docs``.

    ``altered`` replaces fields in a second leaf of the rows ``where`` holds, for checks that a change is noticed;
    ``Manifest.proofs`` folds that leaf with the siblings of the first.
    """
    leaf = leaf_digest([F.col(f) for f in fields])
    other = F.lit(None).cast("binary")
    if altered:
        changed = leaf_digest([altered.get(f, F.col(f)) for f in fields])
        other = F.when(where, changed) if where is not None else changed
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaves = cut(docs.select(group.alias("tree"), F.col(id_col).alias("ids"), leaf.alias("node"), other.alias("altered")))
    groups = tiers(numbered(leaves, "tree", "ids", "node"), ["ids", "altered"])
    subroots = None
    for built in groups:
        own = built.where(F.col("n") <= BLOCK).select(F.lit("").alias("tree"), F.col("tree").alias("names"), root_of("log").alias("node"))
        subroots = own if subroots is None else subroots.unionByName(own)
    whole = tiers(numbered(subroots, "tree", "names"), ["names"])
    return Manifest(groups, whole, id_col)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
