"""Versioned table snapshots: the sink for upserts and streaming state (K5-K8, M1-M3).

A plain Parquet directory cannot be updated in place, and overwriting the
path being read is unsafe. Each write therefore goes to a new version
directory ``<root>/v=<n>``; a version is current once its ``_SUCCESS``
marker exists. ``write_version`` is idempotent per version number, which is
what a ``foreachBatch`` sink needs when a micro-batch is replayed after a
failure. ``create_version`` writes elsewhere and takes the version's name by one
rename that fails if the name is taken: of two writers of a version one
gets an error, and what a dead writer leaves behind is in nobody's way.
Readers take the highest committed version. Old versions can be removed by
a retention job; nothing here deletes data.

Where a table format with MERGE (Delta, Iceberg) is available on the
cluster, ``DataFrame.mergeInto`` replaces this.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Version numbers with a ``_SUCCESS`` marker, ascending (metadata only)."""
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:012d}"


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write ``df`` as version ``version`` (overwrite: idempotent on replay)."""
    p = version_path(root, version)
    df.write.mode("overwrite").parquet(p)
    return p


def free_version(spark: SparkSession, root: str, after: int) -> int:
    """The first number above ``after`` that is not taken by a folder without ``_SUCCESS`` (a dead writer's)."""
    fs, _, jvm = _fs(spark, root)
    at = lambda n, *f: jvm.org.apache.hadoop.fs.Path("/".join([version_path(root, n), *f]))
    n = after + 1
    while fs.exists(at(n)) and not fs.exists(at(n, "_SUCCESS")):
        n += 1
    return n


def create_version(df: DataFrame, root: str, version: int) -> str:
    """Write a version that must not exist yet: a second writer of it fails, and leaves nothing under its name."""
    spark, p = df.sparkSession, version_path(root, version)
    own = f"{root.rstrip('/')}/new-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(own)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(hadoop.Path(own).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        files.rename(hadoop.Path(own), hadoop.Path(p), options)  # fails where the target exists
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(f"[PATH_ALREADY_EXISTS] another writer has written {p}") from e
        raise
    return p


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(version_path(root, version))


def read_current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest committed version (optionally the newest below ``before``)."""
    vs = [v for v in committed_versions(spark, root) if before is None or v < before]
    if not vs:
        return None
    return spark.read.parquet(version_path(root, vs[-1]))


def upsert_into(spark: SparkSession, root: str, source: DataFrame, key: str,
                on_duplicate: str = "error", order: list[str] | None = None,
                initial: DataFrame | None = None) -> int:
    """K5/K6 persisted: merge ``source`` into the current version, write the next.

    The current version is only read; the result goes to a new version
    directory, so a failed write leaves the table as it was. Returns the new
    version number.
    """
    from ..operators.upsert import upsert

    vs = committed_versions(spark, root)
    cur = read_version(spark, root, vs[-1]) if vs else None
    if cur is None:
        if initial is None:
            cur = spark.createDataFrame([], source.select(*[c for c in source.columns
                                                            if c not in (order or [])]).schema)
        else:
            cur = initial
    merged = upsert(cur, source, key, on_duplicate=on_duplicate, order=order)
    nxt = free_version(spark, root, vs[-1] if vs else -1)
    create_version(merged, root, nxt)  # a concurrent writer of the same version fails
    return nxt


def upsert_into_observed(spark: SparkSession, root: str, source: DataFrame, key: str, order: list[str],
                         initial: DataFrame | None = None) -> tuple[int, dict[str, int]]:
    """K5 + K10: ``upsert_into`` that counts while it writes; the source is read once.

    Returns the new version and ``total_sent``, ``uploaded`` (keys written),
    ``inserted`` and ``updated``. The counts are taken by an ``Observation`` in the
    stage that writes, whose tasks count once however often earlier stages run.
    """
    from pyspark.sql import Observation

    from ..operators.upsert import upsert_counted

    vs = committed_versions(spark, root)
    cur = read_version(spark, root, vs[-1]) if vs else initial
    if cur is None:
        cur = spark.createDataFrame([], source.select(*[c for c in source.columns if c not in order]).schema)
    seen = Observation()
    merged, counts = upsert_counted(cur, source, key, order)
    nxt = free_version(spark, root, vs[-1] if vs else -1)
    create_version(merged.observe(seen, *[c.alias(n) for n, c in counts.items()]).select(*cur.columns), root, nxt)
    return nxt, {n: seen.get[n] or 0 for n in counts}
