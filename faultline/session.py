"""Spark session defaults and the shared checkpoint folder.

Everything here is plain Spark configuration: AQE for runtime re-planning
(partition coalescing, skew-join splitting, broadcast conversion behind the
size threshold), UTC session time, and a checkpoint folder read from the
session (``spark.checkpoint.dir``) so that streaming state and lineage cuts
land on the shared storage the cluster names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a cluster submit would normally carry; applied only when unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON.parse keeps the last of duplicate keys; Spark variant parsing
    # rejects them unless this is on.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, app: str = "faultline",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is only set when given, so a cluster submit keeps its own.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set runtime SQL defaults on an existing session where they are unset."""
    for k, v in DEFAULT_CONF.items():
        if k == "spark.sql.variant.allowDuplicateKeys":
            spark.conf.set(k, v)
            continue
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (or the SparkContext checkpoint dir). Only
    when neither is set and the master is local (tests) a private folder is
    created and registered, so later ``checkpoint()`` calls and streaming
    queries use it. On a cluster a folder of the driver is of no use to the
    executors: that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jdir.get() if jdir.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="faultline-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:
            pass
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for written tables/state."""
    return "/".join([checkpoint_dir(spark), *parts])


def local_session() -> SparkSession:
    """Session for tests and the local bench: ``local[$BENCH_CPUS or *]``."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    return build_session(master=f"local[{cpus}]", shuffle_partitions=8,
                         extra={"spark.driver.memory": "8g"})
