"""Tables that are replaced as a whole without a moment in which there is none.

A table is a folder of versions, each written under a name of its own, and of
pointers: empty files ``_current-<number>-<version>``. ``publish`` writes the new
version in full, then creates the next pointer, which is the one step that
switches readers over, and then drops versions older than the one before. A
job that fails or is killed on the way leaves the current version as it was; what it
wrote has no pointer, is never read, and goes with ``vacuum``.

A file appears whole or not at all on file systems and object stores alike, so
no rename and no lock is needed. Of two writers that finish with one number, every reader takes the same version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right under ``path``."""
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    found = [n.removeprefix(POINTER).split("-", 1) for n in names(spark, path) if n.startswith(POINTER)]
    return sorted((int(number), version) for number, version in found)


def current(spark: SparkSession, path: str) -> str:
    """Folder of the current version; ``path`` itself where it holds no versions (a plain Parquet folder)."""
    pointers = _pointers(spark, path)
    return f"{path.rstrip('/')}/{pointers[-1][1]}" if pointers else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 1) -> str:
    """Let ``write`` fill a new folder, make it the current version, and drop all versions but ``keep`` before it.

    The version before stays so that readers that are under way can end. A plain folder of files from
    before there were versions is no longer read once the first version is published, and left as it is."""
    root = path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{version}")
    pointers = _pointers(spark, root)
    number = pointers[-1][0] + 1 if pointers else 1
    fs, at = _fs(spark, f"{root}/{POINTER}{number:010d}-{version}")
    fs.create(at, False).close()
    for old_number, old in pointers[: len(pointers) - keep]:
        for name in (f"{POINTER}{old_number:010d}-{old}", old):  # the pointer first: none ever names a version that is gone
            fs.delete(_fs(spark, f"{root}/{name}")[1], True)
    return f"{root}/{version}"


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Drop versions without a pointer (of jobs that ended early); not while another job writes the table."""
    known = {version for _, version in _pointers(spark, path)}
    gone = [n for n in names(spark, path) if n.startswith("v-") and n not in known]
    for name in gone:
        fs, at = _fs(spark, f"{path.rstrip('/')}/{name}")
        fs.delete(at, True)
    return gone
