"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.session import checkpoint_root


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in a bare local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    return checkpoint_root(spark, fallback=None if named or not local else tempfile.mkdtemp(prefix="lateflow-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of its own in the shared checkpoint folder and read it back.

    For loops: unlike a checkpoint the table carries its real size into the
    next round's plan. ``discard`` removes a table that a later one replaces.
    """
    path = f"{shared_dir(df.sparkSession)}/lateflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    if hasattr(df, "stored_at"):
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, rows: int, *key: str, seed: int = 7) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``key``.

    A threshold on the hash thins the rows first, so that tasks hand on little
    more than ``rows`` rows in sum, however many tasks there are.
    """
    spread = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40))
    total = max(1, df.count())
    most = min(1.0, (rows + 6 * math.sqrt(rows) + 20) / total)
    return df.where(spread < int(most * (1 << 40))).orderBy(spread, *key).limit(rows)


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """An object kept in a Python worker from task to task (caches, loaded models).

    Functions of this package travel by value, so their module globals are new
    in every task; a module registered under its own name is not.
    """
    home = sys.modules.setdefault("lateflow_worker_state", types.ModuleType("lateflow_worker_state"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def latest(slot: str, tag: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps in ``slot``: made anew where it holds none of this ``tag``, and the one before goes."""
    held = worker_state((slot,), dict)
    if tag not in held:
        held.clear()
        held[tag] = make()
    return held[tag]


def release_worker() -> None:
    """Drop what ``worker_state`` keeps and hand freed memory back, at the start of tasks that need it for other things."""
    if sys.modules.pop("lateflow_worker_state", None):
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package by value, as its functions are; ``load`` reads it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def load(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts of a column; null counts as empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw_bytes(column)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of a text's words (bytes between the six ASCII spaces), all of a block at once: sums of bytes' numbers by powers of an odd base, mixed."""

    base = 0xD6E8FEB86659FD93

    def __init__(self, block: int = 65_536):
        self.block = block
        self.number = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True
        self._extend(block + 2)

    def _extend(self, size: int) -> None:
        """Powers of the base and of its inverse."""
        steps = (np.full(size, f, np.uint64) for f in (self.base, pow(self.base, -1, 1 << 64)))
        self.power, self.inverse = (np.multiply.accumulate(x) for x in steps)

    def words(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(b" " + text + b" ", np.uint8)
        gap = self.gap[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edges[::2], edges[1::2]  # the byte before a word and its last one
        out = np.empty(len(first), np.uint64)
        at = 0
        while at < len(first):
            p = int(first[at])
            end = max(at + 1, int(np.searchsorted(last, p + self.block, side="right")))
            q = int(last[end - 1]) + 1
            if q - p > len(self.power):
                self._extend(2 * (q - p))
            total = np.cumsum(self.number[data[p:q]] * self.power[: q - p], dtype=np.uint64)
            begin = first[at:end] - p
            out[at:end] = (total[last[at:end] - p] - total[begin]) * self.inverse[begin]
            at = end
        return mixed(out)
