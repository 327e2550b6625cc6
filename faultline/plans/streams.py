"""Streaming queries over the driver tables, run to completion (availableNow).

Each call streams the table file into a fresh folder under the shared
checkpoint folder and returns the resulting table; the oracle is the batch
answer (for M4: the windows closed by the watermark).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as use
from ..sources.tables import Tables
from ..streaming import jobs
from . import ingest as ingest_plans
from .registry import register


# diagram: null for errors, '' for clicks; verdict: none above 400. Neither is counted.
@register("accuracy_stream", """
WITH f AS (SELECT CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS event_type,
                  CASE WHEN value <= 400 THEN value <= 100 END AS ok FROM events)
SELECT event_type, count(*) AS total_count, CAST(count_if(ok) AS BIGINT) AS correct_count,
       floor(CAST(count_if(ok) AS DOUBLE) / count(*) * 100.0 * 100.0 + 0.5) / 100.0 AS accuracy_rate
FROM f WHERE event_type <> '' AND ok IS NOT NULL GROUP BY event_type""")
def accuracy_stream(spark, sf_dir):
    ev = jobs.file_stream(spark, sf_dir, "events")
    ev = ev.withColumn("event_type", F.when(F.col("event_type") == "click", F.lit("")).when(F.col("event_type") != "error", F.col("event_type")))
    return jobs.accuracy_stream(spark, ev, "event_type", F.when(F.col("value") <= 400, F.col("value") <= 100),
                                jobs.run_dir(spark, "accuracy"))


@register("video_upsert_stream", "WITH " + ingest_plans._SRC_SQL.format(repeats=ingest_plans._REPEATS_SQL)
          + " SELECT * FROM merged")
def video_upsert_stream(spark, sf_dir):
    """The upsert source arrives as a stream derived from the customer file."""
    c = jobs.file_stream(spark, sf_dir, "customer").select(*ingest_plans.CUST)
    upd = c.where(F.col("c_mktsegment") == "AUTOMOBILE") \
           .withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("arrival", F.lit(1))
    new = c.where(F.col("c_mktsegment") == "MACHINERY") \
           .withColumn("c_custkey", F.col("c_custkey") + 1000000000) \
           .withColumn("c_name", F.concat("c_name", F.lit(" (new)"))).withColumn("arrival", F.lit(1))
    again = c.where((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_nationkey") < 10)) \
             .withColumn("c_acctbal", F.col("c_acctbal") + 200).withColumn("arrival", F.lit(2))
    src = upd.unionByName(new).unionByName(again)
    target = Tables(spark, sf_dir).customer.select(*ingest_plans.CUST)
    return jobs.upsert_stream(spark, src, target, "c_custkey", ["arrival"], jobs.run_dir(spark, "upsert"))


@register("latest_session_stream", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE user_id IS NOT NULL) WHERE rn = 1""")
def latest_session_stream(spark, sf_dir):
    ev = jobs.file_stream(spark, sf_dir, "events")
    out = jobs.latest_stream(spark, ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"],
                             jobs.run_dir(spark, "latest"))
    return out.select("user_id", "event_id", "ts", "event_type", "value")


@register("llm_usage_stream", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS calls,
       CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS input_tokens,
       CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens,
       CAST(sum(CAST((CAST(floor(value * 10) AS BIGINT) * 3 + CAST(floor(value) AS BIGINT) * 15) * 0.000001 AS DECIMAL(8,6)))
            AS DECIMAL(18,6)) AS cost_usd
FROM events GROUP BY 1, 2""")
def llm_usage_stream(spark, sf_dir):
    """Calls, tokens and cost per hour and kind; every window, in any order of files."""
    ev = jobs.file_stream(spark, sf_dir, "events")
    ev = ev.withColumns({"input_tokens": F.floor(F.col("value") * 10), "output_tokens": F.floor("value")})
    aggs = [F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.sum(use.cost_usd("input_tokens", "output_tokens")).cast("decimal(18,6)").alias("cost_usd")]
    out = jobs.windowed_usage_stream(spark, ev, "ts", ["event_type"], aggs, "1 hour", None, jobs.run_dir(spark, "usage"))
    return out.select("window_start", "event_type", "calls", "input_tokens", "output_tokens", "cost_usd")


@register("latest_session_stream_evicting", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE user_id IS NOT NULL) WHERE rn = 1""")
def latest_session_stream_evicting(spark, sf_dir):
    """M3 with bounded state: sessions idle for a day leave it, the table keeps them."""
    ev = jobs.file_stream(spark, sf_dir, "events")
    out = jobs.latest_stream_evicting(spark, ev, "user_id", "ts", "event_id",
                                      ["event_id", "ts", "event_type", "value"], "1 day", "1 hour",
                                      jobs.run_dir(spark, "latest-evicting"))
    return out.select("user_id", "event_id", "ts", "event_type", "value")


# Three files by time; every twentieth event comes in the last one, so many of them are late. A batch drops what lies behind
# the watermark that the batch before it went by, which the file before that one has set.
@register("llm_usage_closed_stream", """
WITH s AS (SELECT *, min(ts) OVER () AS t0, max(ts) OVER () AS t1 FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, CASE WHEN event_id % 20 = 7 OR ts >= t0 + (t1 - t0) * 2 / 3 THEN 2 WHEN ts >= t0 + (t1 - t0) / 3 THEN 1 ELSE 0 END AS file,
             time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM s),
w AS (SELECT file, max(max(ts)) OVER (ORDER BY file) - INTERVAL 2 HOUR AS mark FROM f GROUP BY file),
ok AS (SELECT f.* FROM f LEFT JOIN w ON w.file = f.file - 2 WHERE w.mark IS NULL OR window_start + INTERVAL 1 HOUR > w.mark)
SELECT window_start, event_type, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens
FROM ok WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM w) GROUP BY 1, 2""")
def llm_usage_closed_stream(spark, sf_dir):
    """Windows that the watermark has closed, each emitted once; late rows do not reopen them."""
    ev = Tables(spark, sf_dir).events.where("ts IS NOT NULL")
    t0, t1 = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    t0, t1 = t0 or 0, t1 or 0
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    file = F.when((F.col("event_id") % 20 == 7) | (us >= t0 + (t1 - t0) * 2 / 3), 2).when(us >= t0 + (t1 - t0) / 3, 1).otherwise(0)
    folder = jobs.run_dir(spark, "usage-files")
    for n in range(3):  # one after the other, as they arrive
        ev.where(file == n).coalesce(1).write.parquet(f"{folder}/events.parquet/arrival={n}")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet/*")
    src = src.withColumn("output_tokens", F.floor("value"))
    out = jobs.windowed_usage_stream(spark, src, "ts", ["event_type"], [F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output_tokens")],
                                     "1 hour", "2 hours", jobs.run_dir(spark, "usage-closed"))
    return out.select("window_start", "event_type", "calls", "output_tokens")


@register("diagram_stats_stream", """
SELECT event_type AS diagram_id,
       CAST(count(*) AS INTEGER) AS total_matches,
       CAST(count_if(value <= 100) AS INTEGER) AS correct_count,
       CAST(count_if(value > 100 AND value <= 400) AS INTEGER) AS incorrect_count,
       CAST(CAST((count_if(value <= 100) * 20000 + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * 0.01
            AS DECIMAL(5,2)) AS accuracy_pct
FROM events GROUP BY event_type""")
def diagram_stats_stream(spark, sf_dir):
    """K6 as a stream: value <= 100 correct, above 400 no verdict, else incorrect."""
    ev = jobs.file_stream(spark, sf_dir, "events")
    v = F.when(F.col("value") <= 100, F.lit(True)).when(F.col("value") > 400, F.lit(None).cast("boolean")) \
         .otherwise(F.lit(False))
    return jobs.stats_stream(spark, ev, "event_type", v, jobs.run_dir(spark, "stats"))
