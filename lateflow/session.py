"""Spark session settings the library relies on.

Every function in the package is a lazy DataFrame -> DataFrame transform; the
session only has to carry two contracts (stage stamps are ``timestamp_ntz``
and counted without a zone, so the session's zone plays no part):

* AQE on, with skew-join splitting and partition coalescing -- the fact build
  joins on order, customer and seller keys, any of which may be hot.
* ANSI mode left on (the 4.x default): silent overflow would hide bugs in the
  exact decimal arithmetic of ``lateflow.functions.exact``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

SESSION_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "lateflow",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them ``None`` so the cluster's own settings apply.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach; it is
    read, never replaced. Only when it is unset (tests, a bare local session)
    is ``fallback`` installed as the checkpoint dir.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a fallback for local runs")
        root = fallback
    # DataFrame.checkpoint() reads the SparkContext setting, so keep both aligned.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A fresh location under the shared checkpoint folder for one written table."""
    root = checkpoint_root(spark, fallback)
    return os.path.join(root, "lateflow", f"{name}-{uuid.uuid4().hex[:12]}")
