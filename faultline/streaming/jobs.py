"""Structured Streaming jobs (M1-M4).

Sources are file streams over Parquet (``readStream`` with the batch schema
and a glob for the table file); runs use ``availableNow`` so a test drives
a stream to completion. Checkpoints and sink tables live under the shared
checkpoint folder from the session, so a restarted driver resumes where
the last committed micro-batch ended.

* M1 accuracy: stateful ``groupBy`` in update mode; each batch's updated
  counters go to a change log (idempotent per batch id).
* M2 upsert: per batch, dedupe (last arrival wins), then log the rows; the
  table is base + log, last row per key.
* M3 latest per session: stateful ``max_by`` in update mode, logged; or a
  stateful processor whose timers drop the sessions that are idle.
* M4 usage per hour: event-time windows. Without a watermark every window is
  kept current in the change log, whatever order the files come in; with one,
  state is bounded and a window is emitted once the watermark passes its end
  (T23).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.js import percent_half_up
from ..operators.upsert import dedupe_last
from ..session import scratch_path
from ..sources import changelog
from ..sources.tables import table_path


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1000) -> DataFrame:
    """Stream the Parquet files of one table, at most ``max_files`` per micro-batch.

    A table stored as a directory of part files is streamed as that
    directory; a single ``<table>.parquet`` file is picked out of ``sf_dir``
    with a glob.
    """
    path = table_path(sf_dir, table)
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hp).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if is_dir:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_dir(spark: SparkSession, name: str, run_id: str | None = None) -> str:
    """Per-run folder under the shared checkpoint folder."""
    return scratch_path(spark, "streams", name, run_id or uuid.uuid4().hex)


def _log_sink(spark: SparkSession, log: str, key: str | list[str], compact_every: int | None, base: DataFrame | None = None,
              prepare=None, order: list[str] | None = None):
    """foreachBatch sink: append the batch's changed rows; compact every n batches."""
    def sink(batch: DataFrame, batch_id: int):
        changelog.append_batch(prepare(batch) if prepare else batch, log, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            changelog.compact(spark, log, key, base=base, order=order)
    return sink


def _run(query_builder, root: str, trigger_now: bool = True):
    q = query_builder.option("checkpointLocation", f"{root}/checkpoint")
    q = q.trigger(availableNow=True) if trigger_now else q
    handle = q.start()
    handle.awaitTermination()
    if handle.exception() is not None:
        raise handle.exception()
    return handle


# ------------------------------------------------------------------ M1

def accuracy_stream(spark: SparkSession, events: DataFrame, key: str, verdict_expr, root: str,
                    compact_every: int | None = 20) -> DataFrame:
    """M1: per-key counters kept current as rows arrive; returns the table."""
    scored = events.select(F.col(key), verdict_expr.alias("_ok"))
    # the handler counts rows with a diagram and a verdict only
    scored = scored.where(F.col(key).isNotNull() & (F.col(key) != F.lit("")) & F.col("_ok").isNotNull())
    agg = scored.groupBy(key).agg(F.count(F.lit(1)).alias("total_count"),
                                  F.count_if(F.col("_ok")).alias("correct_count"))
    log = f"{root}/table"
    sink = _log_sink(spark, log, key, compact_every)
    _run(agg.writeStream.outputMode("update").foreachBatch(sink), root)
    cur = changelog.current(spark, log, key)
    return cur.withColumn("accuracy_rate", percent_half_up("correct_count", "total_count"))


def stats_stream(spark: SparkSession, events: DataFrame, key: str, verdict_expr, root: str,
                 out_key: str = "diagram_id", compact_every: int | None = 20) -> DataFrame:
    """K6 / M1 (trigger side): total, correct, incorrect and DECIMAL(5,2) percent per key.

    Null verdicts count in the total only, as in the database trigger.
    """
    from ..functions.js import decimal_percent

    scored = events.select(F.col(key).alias(out_key), verdict_expr.alias("_v"))
    agg = scored.groupBy(out_key).agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_if(F.col("_v") == F.lit(True)).alias("correct_count"),
        F.count_if(F.col("_v") == F.lit(False)).alias("incorrect_count"))
    log = f"{root}/table"
    _run(agg.writeStream.outputMode("update").foreachBatch(_log_sink(spark, log, out_key, compact_every)), root)
    cur = changelog.current(spark, log, out_key)
    return cur.select(out_key, *[F.col(c).cast("int").alias(c)
                                 for c in ("total_matches", "correct_count", "incorrect_count")]) \
              .withColumn("accuracy_pct", decimal_percent("correct_count", "total_matches"))


# ------------------------------------------------------------------ M2

def upsert_stream(spark: SparkSession, source: DataFrame, target: DataFrame, key: str,
                  order: list[str], root: str, compact_every: int | None = 20) -> DataFrame:
    """M2: streaming upsert by key; per batch the last arrival of a key wins.

    ``compact_every=n`` folds the log into a base snapshot every n batches.
    """
    cols = target.columns
    log = f"{root}/table"

    sink = _log_sink(spark, log, key, compact_every, base=target,
                     prepare=lambda b: dedupe_last(b, key, order).select(*cols))
    _run(source.writeStream.foreachBatch(sink), root)
    return changelog.current(spark, log, key, base=target).select(*cols)


# ------------------------------------------------------------------ M3

def latest_stream(spark: SparkSession, events: DataFrame, key: str, order: list[str],
                  columns: list[str], root: str, compact_every: int | None = 20) -> DataFrame:
    """M3: the latest row per key, maintained in the state store (update mode)."""
    packed = F.struct(*[F.col(c) for c in columns])
    agg = (events.where(F.col(key).isNotNull()).groupBy(key)
                 .agg(F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_r")))
    flat = agg.select(key, "_r.*")
    log = f"{root}/table"
    _run(flat.writeStream.outputMode("update").foreachBatch(_log_sink(spark, log, key, compact_every)), root)
    return changelog.current(spark, log, key)


# ------------------------------------------------------------------ M4

def windowed_usage_stream(spark: SparkSession, events: DataFrame, ts: str, keys: list[str],
                          aggs: list, window: str, watermark: str | None, root: str,
                          compact_every: int | None = 20, progress: list | None = None) -> DataFrame:
    """M4: event-time windows per key.

    ``watermark=None``: no row is ever late. Updated windows go to the change
    log, so the result is the same for any number and order of files, and the
    last windows are in it. State then holds every window.

    With a watermark (append mode, Parquet sink) state is bounded; rows that
    arrive behind it are dropped by Spark and open windows are not emitted.
    ``progress`` receives the progress of the query; its state operators count
    the rows dropped.
    ``timestamp_ntz`` cannot carry one, so the time column is cast to
    ``timestamp`` (session time zone UTC). Null times belong to no window.
    """
    x = events.withColumn("_et", F.col(ts).cast("timestamp")).where(F.col("_et").isNotNull())
    if watermark is not None:
        x = x.withWatermark("_et", watermark)
    g = x.groupBy(F.window("_et", window).alias("_w"), *keys).agg(*aggs)
    out = g.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *keys,
                   *[c for c in g.columns if c not in ("_w", *keys)])
    table = f"{root}/table"
    if watermark is not None:
        handle = _run(out.writeStream.outputMode("append").format("parquet").option("path", table), root)
        if progress is not None:
            progress.extend(handle.recentProgress)
        return spark.read.schema(out.schema).parquet(table)
    sink = _log_sink(spark, table, ["window_start", *keys], compact_every)
    _run(out.writeStream.outputMode("update").foreachBatch(sink), root)
    return changelog.current(spark, table, ["window_start", *keys])


# ------------------------------------------------------------------ M3 (bounded state)

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LatestRow(StatefulProcessor):
    """The newest row of each key, kept until the watermark has passed it by the idle time."""

    def __init__(self, columns: list[str], state: StructType, idle_ms: int):
        self.columns, self.state, self.idle_ms = columns, state, idle_ms

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", self.state)  # the rank (time in ms, tiebreak), then the row

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        best = self.last.get() if self.last.exists() else None
        newer = max((((r["_ms"], r["_tie"]), tuple(r[c] for c in self.columns)) for r in rows), key=lambda x: x[0])
        if best is not None and tuple(best[:2]) >= newer[0]:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((*newer[0], *newer[1]))
        self.handle.registerTimer(newer[0][0] + self.idle_ms)
        yield Row(**dict(zip(self.columns, newer[1], strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()
        return iter(())


def latest_stream_evicting(spark: SparkSession, events: DataFrame, key: str, ts: str, tiebreak: str,
                           columns: list[str], idle_timeout: str | None, watermark: str | None, root: str,
                           compact_every: int | None = 20, progress: list | None = None) -> DataFrame:
    """M3 with bounded state: the newest row per key by (``ts``, ``tiebreak``).

    With both ``idle_timeout`` and ``watermark`` a stateful processor keeps the
    newest row of each key; a timer drops it once the watermark has passed its
    time by ``idle_timeout``, so state holds the keys that were active lately. The
    table keeps every key: it is the newest row per key over base and log, so a
    row that comes after its key was dropped is stored again and an older one
    changes nothing. Rows behind the watermark when they arrive are late and are
    dropped, as are rows without a key, a time or a ``tiebreak`` (an integer).
    ``progress`` receives the progress of the query, its state rows among it.

    Without them nothing is kept between batches: each batch is reduced to one row
    per key (``max_by``, combined map-side) and logged; late rows and files in
    any order give the same table, and rows without a time rank below the others.
    """
    order = [ts, tiebreak]
    log, keep = f"{root}/table", [key, *columns]
    if idle_timeout is None or watermark is None:
        packed = F.struct(*[F.col(c) for c in keep])

        def newest(batch: DataFrame) -> DataFrame:
            rows = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_r"))
            return rows.select("_r.*")

        handle = _run(events.writeStream.foreachBatch(_log_sink(spark, log, key, compact_every, prepare=newest, order=order)), root)
    else:
        x = events.withColumn("_et", F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col("_et").isNotNull() & F.col(tiebreak).isNotNull())
        x = x.withWatermark("_et", watermark).select("_et", F.unix_millis("_et").alias("_ms"), F.col(tiebreak).cast("long").alias("_tie"), *keep)
        out = StructType([x.schema[c] for c in keep])
        state = StructType([StructField("_ms", LongType()), StructField("_tie", LongType()), *[StructField(f"c{i}", f.dataType) for i, f in enumerate(out)]])
        idle_ms = spark.sql(f"SELECT CAST(1000 * extract(SECOND FROM x) + 60000 * extract(MINUTE FROM x) + 3600000 * extract(HOUR FROM x) + 86400000 * extract(DAY FROM x) AS BIGINT) "
                            f"FROM (SELECT CAST(INTERVAL {idle_timeout} AS INTERVAL DAY TO SECOND) AS x)").first()[0]
        latest = x.groupBy(key).transformWithState(LatestRow(keep, state, idle_ms), out, "update", "EventTime")
        before = spark.conf.get(STATE_PROVIDER)
        spark.conf.set(STATE_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            handle = _run(latest.writeStream.outputMode("update").foreachBatch(_log_sink(spark, log, key, compact_every, order=order)), root)
        finally:
            spark.conf.set(STATE_PROVIDER, before)
    if progress is not None:
        progress.extend(handle.recentProgress)
    return changelog.current(spark, log, key, order=order).select(*keep)
