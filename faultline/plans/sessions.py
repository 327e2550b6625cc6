"""Session queries bound to events: session = user_id, analyses = 'view'
events, model results = 'purchase' events (SURVEY 7.4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.chunks import time_chunker
from ..operators import ingest as ing
from ..operators import sessions as ses
from ..session import scratch_path
from ..sources import snapshots
from ..sources.tables import Tables
from .registry import register


@register("latest_per_session", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE user_id IS NOT NULL) WHERE rn = 1""")
def latest_per_session(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("user_id", "event_id", "ts", "event_type", "value")
    return ses.latest_per_key(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


@register("llm_attach_latest", """
WITH latest AS (
  SELECT user_id, event_id AS analysis_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE event_type = 'view' AND user_id IS NOT NULL) WHERE rn = 1
),
p AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events
  WHERE event_type = 'purchase'
),
d AS (
  SELECT event_id, user_id,
    CASE WHEN k % 10 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS llm_diagram_id,
    CAST((k + user_id) % 100 AS VARCHAR) AS engine_diagram_id,
    CAST(floor(value) AS INTEGER) % 101 AS llm_fault_a,
    (CAST(floor(value) AS INTEGER) % 5) * 20 AS llm_confidence,
    CAST(floor(value * 10) AS INTEGER) % 7 AS llm_tokens
  FROM p
)
SELECT d.event_id AS llm_event_id, d.user_id AS session_id, l.analysis_id,
  nullif(llm_diagram_id, '') AS llm_diagram_id, llm_fault_a, CAST(NULL AS INTEGER) AS llm_fault_b,
  nullif(llm_confidence, 0) AS llm_confidence, '' AS llm_reasoning, '' AS llm_analysis,
  0 AS n_modifiers, llm_tokens,
  coalesce(llm_diagram_id, '') = coalesce(engine_diagram_id, '') AS matches_engine
FROM d JOIN latest l ON d.user_id = l.user_id""")
def llm_attach_latest(spark, sf_dir):
    """PATCH as a batch: each model result (a purchase) goes to its session's
    latest analysis (a view), shaped as the model-result record."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    views = ev.where(F.col("event_type") == "view")
    k = F.get_json_object("props", "$.k").cast("int")
    iv = F.floor("value").cast("int")
    results = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("llm_event_id"), F.col("user_id"),
        F.when(k % 10 == 0, F.lit("")).otherwise(k.cast("string")).alias("llm_diagram_id"),
        ((k + F.col("user_id")) % 100).cast("string").alias("engine_diagram_id"),
        (iv % 101).alias("llm_fault_a"),
        ((iv % 5) * 20).alias("llm_confidence"),
        (F.floor(F.col("value") * 10).cast("int") % 7).alias("llm_tokens"))
    shaped = ing.shape_llm_records(results)
    out = ses.attach_to_latest(shaped, views, "user_id", ["ts", "event_id"], "event_id")
    return out.select("llm_event_id", F.col("user_id").alias("session_id"), "analysis_id", "llm_diagram_id",
                      "llm_fault_a", "llm_fault_b", "llm_confidence", "llm_reasoning", "llm_analysis",
                      F.size("llm_modifiers").alias("n_modifiers"), "llm_tokens", "matches_engine")


# Sessions are null above 450, times below 2: such rows match nothing.
@register("llm_attach_asof", """
WITH e AS (SELECT event_id, event_type, CASE WHEN value <= 450 THEN user_id END AS user_id, CASE WHEN value >= 2 THEN ts END AS ts FROM events),
     v AS (SELECT user_id, ts, event_id FROM e WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL),
     p AS (SELECT user_id, ts, event_id FROM e WHERE event_type = 'purchase')
SELECT p.event_id AS llm_event_id, p.user_id AS session_id, p.ts AS llm_ts,
       v.event_id AS analysis_id, v.ts AS analysis_ts
FROM (SELECT * FROM p WHERE user_id IS NOT NULL AND ts IS NOT NULL) p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def llm_attach_asof(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumns({"user_id": F.when(F.col("value") <= 450, F.col("user_id")), "ts": F.when(F.col("value") >= 2, F.col("ts"))})
    views = ev.where(F.col("event_type") == "view").select("user_id", "ts", "event_id")
    buys = ev.where(F.col("event_type") == "purchase").select("user_id", "ts", "event_id")
    chunk = time_chunker(ev.where(F.col("event_type").isin("view", "purchase")), "ts")
    out = ses.asof_attach(buys, views, "user_id", "ts", ["event_id", "ts"], chunk=chunk, tiebreak="event_id")
    return out.select(F.col("event_id").alias("llm_event_id"), F.col("user_id").alias("session_id"),
                      F.col("ts").alias("llm_ts"), F.col("match_event_id").alias("analysis_id"),
                      F.col("match_ts").alias("analysis_ts"))


# The reply marks the session's latest analysis: its flag and response, and nothing else, change.
@register("llm_mark_used", """
WITH view AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
latest AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM view WHERE user_id IS NOT NULL) WHERE rn = 1),
last_reply AS (SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS reply FROM events
               WHERE event_type = 'purchase' AND user_id IS NOT NULL GROUP BY user_id)
SELECT view.event_id, view.user_id, r.reply IS NOT NULL AS llm_used,
       CASE WHEN r.reply IS NOT NULL THEN '{"reply":' || CAST(r.reply AS VARCHAR) || '}' END AS llm_response
FROM view LEFT JOIN latest l ON view.event_id = l.event_id LEFT JOIN last_reply r ON r.user_id = l.user_id""")
def llm_mark_used(spark, sf_dir):
    """K8 run as a write: attach every reply, update the analyses, store the table, read it back."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    views = ev.where(F.col("event_type") == "view").drop("event_type")
    replies = ev.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("reply_ts"), F.col("event_id").alias("reply_id"),
        F.parse_json(F.concat(F.lit('{"reply":'), F.col("event_id").cast("string"), F.lit("}"))).alias("llm_response"))
    attached = ses.attach_to_latest(replies, views, "user_id", ["ts", "event_id"], "event_id")
    analyses = views.select("event_id", "user_id")
    updated = ses.mark_used(analyses, attached, "event_id", response="llm_response", order=["reply_ts", "reply_id"])
    root = scratch_path(spark, "tables", "analyses", uuid.uuid4().hex)
    snapshots.create_version(updated.withColumn("llm_response", F.to_json("llm_response")), root, 0)
    return snapshots.read_current(spark, root).select("event_id", "user_id", "llm_used", "llm_response")


@register("llm_agreement", """
WITH x AS (
  SELECT event_id,
         CASE WHEN event_type <> 'error' THEN user_id END AS llm_id,
         CASE WHEN value <= 400 THEN user_id % 100 END AS engine_id
  FROM events
)
SELECT event_id, llm_id, engine_id,
       coalesce(nullif(CAST(llm_id AS VARCHAR), '0'), '') = coalesce(nullif(CAST(engine_id AS VARCHAR), '0'), '') AS matches_engine,
       coalesce(nullif(CAST(llm_id AS VARCHAR), '0'), '') <> '' AND coalesce(nullif(CAST(engine_id AS VARCHAR), '0'), '') <> '' AS both_present
FROM x""")
def llm_agreement(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_id", "event_type", "user_id", "value")
    x = ev.select("event_id",
                  F.when(F.col("event_type") != "error", F.col("user_id")).alias("llm_id"),
                  F.when(F.col("value") <= 400, F.col("user_id") % 100).alias("engine_id"))
    same, both = ses.agreement("llm_id", "engine_id", numeric=True)
    return x.select("event_id", "llm_id", "engine_id", same.alias("matches_engine"), both.alias("both_present"))
