"""Stored tables and functions: declared defaults, table functions, stored variants, appends, bodies from files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest as ing
from ..operators import reports as rep
from ..operators import search as srch
from ..session import scratch_path
from ..sources import catalog as cat
from ..sources import snapshots
from ..sources.tables import Tables, json_array_records, read_json_bodies
from . import accuracy as accuracy_plans
from . import ingest as ingest_plans
from . import search as search_plans
from . import sessions as session_plans
from . import text as text_plans
from .registry import ORACLES, register


def _root(spark, name):
    return scratch_path(spark, "tables", name, uuid.uuid4().hex)


# ------------------------------------------------------------ declared defaults

@register("precedent_defaults", """
SELECT 'case-' || CAST(p_partkey AS VARCHAR) AS case_number, p_brand AS court, p_size AS fault_a, CAST(CASE WHEN p_size % 3 = 2 THEN NULL ELSE 100 - p_size END AS INTEGER) AS fault_b,
       CAST(CASE p_size % 3 WHEN 0 THEN 50 WHEN 1 THEN NULL ELSE p_size * 2 END AS INTEGER) AS confidence,
       CASE WHEN p_size % 3 = 2 THEN p_size > 25 ELSE false END AS verified,
       CASE p_size % 3 WHEN 0 THEN 'user' WHEN 1 THEN NULL ELSE 'crawl' END AS source, true AS dated
FROM part""")
def precedent_defaults(spark, sf_dir):
    """Three inserts into a table with declared defaults: columns left out, explicit NULLs, all values given."""
    p = Tables(spark, sf_dir).part
    base = p.select(F.concat(F.lit("case-"), F.col("p_partkey").cast("string")).alias("case_number"), F.col("p_brand").alias("court"),
                    F.col("p_size").alias("fault_a"), (100 - F.col("p_size")).alias("fault_b"))
    table = cat.create_table(spark, cat.PRECEDENT_COLUMNS, "precedents")
    size = F.col("fault_a")
    cat.insert(spark, table, base.where(size % 3 == 0))
    cat.insert(spark, table, base.where(size % 3 == 1).withColumns({"confidence": F.lit(None).cast("int"), "source": F.lit(None).cast("string")}))
    cat.insert(spark, table, base.where(size % 3 == 2).drop("fault_b").withColumns({"source": F.lit("crawl"), "verified": size > 25, "confidence": size * 2}))
    return spark.table(table).select("case_number", "court", "fault_a", "fault_b", "confidence", "verified", "source", F.col("created_at").isNotNull().alias("dated"))


@register("feedback_defaults", """
SELECT l_orderkey AS analysis_id, l_returnflag <> 'N' AS is_correct, CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) END AS correct_diagram,
       CASE l_returnflag WHEN 'A' THEN 'expert' WHEN 'R' THEN NULL ELSE 'user' END AS expert_level, true AS dated
FROM lineitem""")
def feedback_defaults(spark, sf_dir):
    """Feedback rows without a level are a user's, those with an explicit NULL stay without."""
    li = Tables(spark, sf_dir).lineitem
    rows = li.select("l_returnflag", F.col("l_orderkey").alias("analysis_id"), (F.col("l_returnflag") != "N").alias("is_correct"),
                     F.when(F.col("l_linenumber") == 1, F.col("l_partkey").cast("string")).alias("correct_diagram"))
    table = cat.create_table(spark, cat.FEEDBACK_COLUMNS, "feedback")
    flag = F.col("l_returnflag")
    cat.insert(spark, table, rows.where(~flag.isin("A", "R")).drop("l_returnflag"))
    given = F.when(flag == "A", "expert")
    cat.insert(spark, table, rows.where(flag.isin("A", "R")).withColumn("expert_level", given).drop("l_returnflag"))
    return spark.table(table).select("analysis_id", "is_correct", "correct_diagram", "expert_level", F.col("created_at").isNotNull().alias("dated"))


# -------------------------------------------------------- stored table function

@register("violation_stats_function", """
SELECT l_returnflag AS violation_type, l_linestatus AS sub_type, count(*) AS cnt, GROUPING(l_returnflag) = 1 AS is_total, CAST('all' AS VARCHAR) AS asked
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())
UNION ALL
SELECT l_returnflag, l_linestatus, count(*), GROUPING(l_returnflag) = 1, 'R'
FROM lineitem WHERE l_returnflag = 'R' GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def violation_stats_function(spark, sf_dir):
    """The violation report as a stored table function, called for all types and for one."""
    view = f"violations_{uuid.uuid4().hex}"
    Tables(spark, sf_dir).lineitem.select("l_returnflag", "l_linestatus").createOrReplaceTempView(view)
    f = cat.table_function(
        spark, "violation_stats", "violation STRING DEFAULT NULL", "violation_type STRING, sub_type STRING, cnt BIGINT, is_total BOOLEAN",
        f"SELECT l_returnflag, l_linestatus, count(*), grouping(l_returnflag) = 1 FROM {view} "
        "WHERE violation IS NULL OR l_returnflag = violation GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")
    return spark.sql(f"SELECT *, 'all' AS asked FROM {f}() UNION ALL SELECT *, 'R' FROM {f}('R')")


# ------------------------------------------------------------------- variants

@register("video_stored_variant", f"""WITH {ingest_plans.VIDEO_JSON_SQL}
SELECT o_orderkey, json_extract_string(body, '$.video_name') AS video_name, TRY_CAST(json_extract_string(body, '$.accident_negligence_rateA') AS DOUBLE) AS rate_a FROM b""")
def video_stored_variant(spark, sf_dir):
    """Raw records stored once as VARIANT; the report reads two paths of them, and only these are scanned."""
    rows = ingest_plans.video_json(spark, sf_dir)
    inner = F.expr("coalesce(try_variant_get(parse_json(raw_json), '$.video', 'variant'), parse_json(raw_json))")
    stored = cat.store_variant(rows.select("o_orderkey", F.to_json(inner).alias("raw_json")), "raw_json", _root(spark, "raw"))
    return stored.select("o_orderkey", F.try_variant_get("raw_json", "$.video_name", "string").alias("video_name"),
                         F.try_variant_get("raw_json", "$.accident_negligence_rateA", "double").alias("rate_a"))


# -------------------------------------------------------------------- appends

def _appended(spark, rows, name):
    """Append with a new id and time, read back; every row has both."""
    stored = ing.append_returning(rows, _root(spark, name), returning=("id", "created_at", *rows.columns))
    return stored.where("id IS NOT NULL AND created_at IS NOT NULL").select(*rows.columns)


@register("llm_usage_append", ORACLES["llm_cost_ledger"].replace("SELECT *, cost_usd IS NULL AS cost_rejected FROM ledger",
                                                                 "SELECT *, cost_usd IS NULL AS cost_rejected FROM ledger WHERE purpose IN ('match', 'analyze', 'report')"))
def llm_usage_append(spark, sf_dir):
    """Usage rows of a declared purpose are appended to the ledger and read back."""
    rows = text_plans.llm_cost_ledger(spark, sf_dir)
    return _appended(spark, ing.valid_rows(ing.validate(rows, ing.domain_rules(ing.USAGE_DOMAINS))), "llm_usage")


@register("llm_results_append", ORACLES["llm_attach_latest"])
def llm_results_append(spark, sf_dir):
    """K3: shaped model results, attached to their analyses, are appended and read back."""
    return _appended(spark, session_plans.llm_attach_latest(spark, sf_dir), "llm_analyses")


@register("feedback_append", ORACLES["feedback_scored"])
def feedback_append(spark, sf_dir):
    """K4: scored feedback is appended and read back."""
    return _appended(spark, accuracy_plans.feedback_scored(spark, sf_dir), "analysis_feedback")


@register("video_upsert_observed", ORACLES["video_upsert_summary"])
def video_upsert_observed(spark, sf_dir):
    """The upload is merged and written in one pass that also counts it."""
    src = ingest_plans._source(spark, sf_dir, with_repeats=True)
    _, counts = snapshots.upsert_into_observed(spark, _root(spark, "videos"), src, "c_custkey", ["arrival"], initial=ingest_plans._target(spark, sf_dir))
    return spark.createDataFrame([counts], "total_sent long, uploaded long, inserted long, updated long")


# --------------------------------------------------------- bodies, answers, domains

_BODY_COLUMNS = ["video_name", "video_date", "filming_way", "point_of_view", "rate_a", "rate_b", "accident_place", "vehicle_a_info", "accident_type", "weather", "has_mp4", "odd_values"]


def _picked(sql: str, columns: list[str]) -> str:
    head, tail = sql.rsplit("\nSELECT o_orderkey,\n", 1)
    return f"{head}\nSELECT {', '.join(columns)} FROM (SELECT o_orderkey,\n{tail}) x"


@register("video_upload_files", _picked(ORACLES["video_flatten"], _BODY_COLUMNS))
def video_upload_files(spark, sf_dir):
    """Request bodies ``{"records": [...]}`` written as files, read whole, exploded and flattened."""
    o = ingest_plans.video_json(spark, sf_dir)
    body = F.concat(F.lit('{"records":['), F.array_join(F.collect_list("raw_json"), ","), F.lit("]}"))
    bodies = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(body.alias("value"))  # a thousand records a body
    path = _root(spark, "bodies")
    bodies.write.partitionBy("file").text(path)
    records = json_array_records(read_json_bodies(spark, path), "body")
    return ing.flatten_video_records(records).select(*_BODY_COLUMNS)


@register("precedent_search_envelope", f"""WITH {search_plans.PRECEDENTS_SQL},
top AS (SELECT id, case_number, court, fault_ratio, fault_a FROM precedents WHERE keywords_text ILIKE '%ring%' ORDER BY relevance_score DESC NULLS FIRST, id LIMIT 20)
SELECT count(*) AS count, CAST(to_json(list({{'id': id, 'case_number': case_number, 'court': court, 'fault_ratio': fault_ratio, 'fault_a': fault_a}}
                                              ORDER BY id)) AS VARCHAR) AS results FROM top""")
def precedent_search_envelope(spark, sf_dir):
    """K9: the answer of a search as one ``{count, results}`` row."""
    top = srch.search(search_plans.precedents(spark, sf_dir), srch.SearchRequest(keywords="ring", limit="20"))
    return rep.envelope(top.select("id", "case_number", "court", "fault_ratio", "fault_a"), 50, F.asc("id"))


@register("declared_domains", """
SELECT 'feedback' AS stored_in, l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_returnflag = 'R' THEN 'bad_expert_level' END AS reject_reason FROM lineitem
UNION ALL SELECT 'precedents', p_partkey, CASE WHEN p_type = 'PROMO' THEN 'bad_accident_type' WHEN p_size > 40 THEN 'bad_source' END FROM part
UNION ALL SELECT 'llm_usage', event_id, CASE WHEN event_type = 'error' THEN 'bad_purpose' END FROM events""")
def declared_domains(spark, sf_dir):
    """the declared domains of feedback, precedents and usage; a null passes, an empty text does not."""
    t = Tables(spark, sf_dir)
    flag = F.col("l_returnflag")
    fb = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
                           F.when(flag == "A", "lawyer").when(flag == "R", "").alias("expert_level"))
    pr = t.part.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_type") == "PROMO", "차대기차").when(F.col("p_type") == "SMALL", "차대사람").alias("accident_type"),
                       F.when(F.col("p_size") > 40, "press").otherwise("crawl").alias("source"))
    us = t.events.select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "error", "chat").when(F.col("event_type") != "view", "report").alias("purpose"))
    out = None
    for name, rows, domains in (("feedback", fb, ing.FEEDBACK_DOMAINS), ("precedents", pr, ing.PRECEDENT_DOMAINS), ("llm_usage", us, ing.USAGE_DOMAINS)):
        one = ing.validate(rows, ing.domain_rules(domains)).select(F.lit(name).alias("stored_in"), F.col("row_id").cast("long").alias("row_id"), "reject_reason")
        out = one if out is None else out.unionByName(one)
    return out
