"""Append-only change log keyed table: the sink for streaming upserts (M1-M3, K6-K8).

Each micro-batch writes only the rows it changed, to its own directory
``<root>/batch_id=<n>`` (overwrite, so a replayed batch is idempotent). The
current table is the last row per key over base + log -- a ``max_by``
aggregate, combined map-side, so neither the writer nor the reader ever
rewrites or gathers the whole table.

``compact`` folds everything up to a batch into ``<root>/_base/v=<batch>``;
readers then take the newest base and only the later batches, so the read
cost stays bounded however long the stream runs. Compacting the same batch
again rewrites the same folder, so it is idempotent too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import dedupe_last

BATCH_COL = "_batch_id"
SEQ_COL = "_seq"


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Write one micro-batch of changed rows (idempotent per ``batch_id``)."""
    out = df.withColumn(BATCH_COL, F.lit(batch_id).cast("bigint"))
    if SEQ_COL not in out.columns:
        out = out.withColumn(SEQ_COL, F.lit(0).cast("bigint"))
    out.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch_id={batch_id:012d}")


def _batch_dirs(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Committed batch folders as (batch_id, path), metadata only."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((int(st.getPath().getName().split("=", 1)[1]), st.getPath().toString())
                  for st in fs.listStatus(path)
                  if st.isDirectory() and st.getPath().getName().startswith("batch_id=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))


def _base_root(root: str) -> str:
    return f"{root.rstrip('/')}/_base"


def read_log(spark: SparkSession, root: str, schema=None, after: int | None = None) -> DataFrame | None:
    """Logged rows (only batches after ``after`` when given), or None."""
    dirs = [p for b, p in _batch_dirs(spark, root) if after is None or b > after]
    if not dirs:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(*dirs)


def current(spark: SparkSession, root: str, key: str | list[str], base: DataFrame | None = None,
            order: list[str] | None = None) -> DataFrame | None:
    """Last version of every key over the base and the log.

    The last one is that of the latest batch, or, with ``order``, the greatest
    by these columns whatever batch brought it. A null key is a key: logged
    rows are the state of one key each.

    A compacted base (see ``compact``) replaces ``base`` and the batches it
    covers; otherwise ``base`` (batch -1) and the whole log are read.
    """
    from .snapshots import committed_versions, read_current

    done = committed_versions(spark, _base_root(root))
    after = None
    if done:
        base, after = read_current(spark, _base_root(root)), done[-1]
    log = read_log(spark, root, after=after)
    if log is None and base is None:
        return None
    parts = []
    if base is not None:
        parts.append(base.withColumn(BATCH_COL, F.lit(-1).cast("bigint")).withColumn(SEQ_COL, F.lit(0).cast("bigint")))
    if log is not None:
        parts.append(log)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    if base is not None and not order and log is not None:
        # rows of the base that the log replaces need no ranking
        keys = [key] if isinstance(key, str) else key
        new = dedupe_last(log, key, [BATCH_COL, SEQ_COL], null_is_key=True)
        seen = new.select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_seen_{k}"))
        return parts[0].join(seen, cond, "left_anti").unionByName(new, allowMissingColumns=True).drop(BATCH_COL, SEQ_COL)
    return dedupe_last(u, key, [*(order or []), BATCH_COL, SEQ_COL], null_is_key=True).drop(BATCH_COL, SEQ_COL)


def compact(spark: SparkSession, root: str, key: str | list[str], base: DataFrame | None = None,
            order: list[str] | None = None) -> int | None:
    """Fold base + log into ``<root>/_base/v=<last batch>``; returns that batch id.

    Readers keep working during compaction: the new base is a new folder,
    and it only becomes visible once committed.
    """
    from .snapshots import write_version

    batches = _batch_dirs(spark, root)
    if not batches:
        return None
    upto = batches[-1][0]
    cur = current(spark, root, key, base=base, order=order)
    write_version(cur, _base_root(root), upto)
    return upto
