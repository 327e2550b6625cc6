"""Ingest queries bound to the driver tables.

video records = JSON text built from orders (every second record wrapped in
``video``, the type under one of two keys); analysis records = documents;
upsert target = customer; FK child/parent = lineitem/orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest as ing
from ..operators import upsert as ups
from ..session import scratch_path
from ..sources.tables import Tables
from .registry import register

# ---------------------------------------------------------------- JSON records

def video_json(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    inner = F.concat(
        F.lit('{"video_name":"v'), s(k),
        F.lit('","video_date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","filming_way":"'), F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.lit("dashcam")),
        F.lit('","video_point_of_view":'), s(ck % 3),
        F.lit(',"accident_negligence_rateA":'), s(ck % 101), F.when(F.col("o_orderstatus") == "P", F.lit(".5")).otherwise(F.lit("")),
        F.lit(',"accident_negligence_rateB":'),
        F.when(F.dayofmonth("o_orderdate") == 1, F.lit("null")).otherwise(s(F.lit(100) - ck % 101)),
        F.lit(',"accident_place":'), F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit('"교차로"')).otherwise(F.substring("o_orderpriority", 1, 1)),
        F.lit(',"vehicle_a_progress_info":'), s(ck % 7),
        F.lit(',"'), F.when(k % 3 == 0, F.lit("traffic_accident_type")).otherwise(F.lit("accident_type")),
        F.lit('":'), s(k % 50),
        F.lit(',"weather":"'), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit("clear")),
        F.lit('"'),
        F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(
            F.concat(F.lit(',"has_mp4":'), F.when(F.col("o_orderstatus") == "F", F.lit("true")).otherwise(F.lit("false")))),
        F.lit("}"))
    raw = F.when(k % 2 == 1, F.concat(F.lit('{"video":'), inner, F.lit("}"))).otherwise(inner)
    return o.select("o_orderkey", raw.alias("raw_json"))


VIDEO_JSON_SQL = """
src AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN '{"video":' || rec || '}' ELSE rec END AS raw_json
  FROM (
    SELECT o_orderkey,
      '{"video_name":"v' || CAST(o_orderkey AS VARCHAR)
      || '","video_date":"' || strftime(o_orderdate, '%Y-%m-%d')
      || '","filming_way":"' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'dashcam' END
      || '","video_point_of_view":' || CAST(o_custkey % 3 AS VARCHAR)
      || ',"accident_negligence_rateA":' || CAST(o_custkey % 101 AS VARCHAR) || CASE WHEN o_orderstatus = 'P' THEN '.5' ELSE '' END
      || ',"accident_negligence_rateB":' || CASE WHEN day(o_orderdate) = 1 THEN 'null' ELSE CAST(100 - o_custkey % 101 AS VARCHAR) END
      || ',"accident_place":' || CASE WHEN o_orderpriority = '3-MEDIUM' THEN '"교차로"' ELSE substr(o_orderpriority, 1, 1) END
      || ',"vehicle_a_progress_info":' || CAST(o_custkey % 7 AS VARCHAR)
      || ',"' || CASE WHEN o_orderkey % 3 = 0 THEN 'traffic_accident_type' ELSE 'accident_type' END
      || '":' || CAST(o_orderkey % 50 AS VARCHAR)
      || ',"weather":"' || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'clear' END || '"'
      || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ',"has_mp4":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END END
      || '}' AS rec
    FROM orders)
),
b AS (
  SELECT o_orderkey, raw_json,
         CASE WHEN json_extract(raw_json, '$.video') IS NOT NULL
                   AND json_type(json_extract(raw_json, '$.video')) = 'OBJECT'
              THEN json_extract(raw_json, '$.video') ELSE CAST(raw_json AS JSON) END AS body
  FROM src
)"""


def _given(*keys):
    return "coalesce(" + ", ".join(f"json_extract_string(body, '$.{k}')" for k in keys) + ")"


def _whole(*keys):
    t = _given(*keys)
    return f"CASE WHEN regexp_matches({t}, '^-?[0-9]+([.]0+)?$') THEN CAST(CAST({t} AS DOUBLE) AS INTEGER) END"


def _odd(column, *keys):
    return f"CASE WHEN {_given(*keys)} IS NOT NULL AND {_whole(*keys)} IS NULL THEN '{column}=' || {_given(*keys)} END"


_WHOLE = [("point_of_view", "video_point_of_view"), ("rate_a", "accident_negligence_rateA"), ("rate_b", "accident_negligence_rateB"),
          ("accident_object", "accident_object"), ("accident_place", "accident_place"), ("place_feature", "accident_place_feature"),
          ("vehicle_a_info", "vehicle_a_progress_info"), ("vehicle_b_info", "vehicle_b_progress_info"),
          ("accident_type", "accident_type", "traffic_accident_type")]


@register("video_flatten", f"""WITH {VIDEO_JSON_SQL}
SELECT o_orderkey,
  json_extract_string(body, '$.video_name') AS video_name,
  nullif(json_extract_string(body, '$.video_date'), '') AS video_date,
  nullif(json_extract_string(body, '$.filming_way'), '') AS filming_way,
  {_whole('video_point_of_view')} AS point_of_view,
  {_whole('accident_negligence_rateA')} AS rate_a,
  {_whole('accident_negligence_rateB')} AS rate_b,
  {_whole('accident_object')} AS accident_object,
  {_whole('accident_place')} AS accident_place,
  {_whole('accident_place_feature')} AS place_feature,
  {_whole('vehicle_a_progress_info')} AS vehicle_a_info,
  {_whole('vehicle_b_progress_info')} AS vehicle_b_info,
  {_whole('accident_type', 'traffic_accident_type')} AS accident_type,
  nullif(json_extract_string(body, '$.damage_location'), '') AS damage_location,
  nullif(json_extract_string(body, '$.related_laws'), '') AS related_laws,
  nullif(json_extract_string(body, '$.violation_of_law'), '') AS violation_of_law,
  nullif(json_extract_string(body, '$.additional_elements'), '') AS additional_elements,
  nullif(json_extract_string(body, '$.violation_factor'), '') AS violation_factor,
  nullif(json_extract_string(body, '$.weather'), '') AS weather,
  coalesce(TRY_CAST(json_extract_string(body, '$.has_mp4') AS BOOLEAN), false) AS has_mp4,
  raw_json,
  nullif(concat_ws(';', {', '.join(_odd(*x) for x in _WHOLE)}), '') AS odd_values
FROM b""")
def video_flatten(spark, sf_dir):
    return ing.flatten_video_records(video_json(spark, sf_dir), keep=["o_orderkey"])


# ------------------------------------------------------------ validation

DOC_RULES_SQL = """
CASE WHEN text IS NULL OR text = '' THEN 'missing_text'
     WHEN lang IS NOT NULL AND lang NOT IN ('en', 'fr', 'de', 'ko') THEN 'bad_lang'
     WHEN source IS NULL OR source = '' THEN 'missing_source'
END"""


@register("validate_quarantine", f"""
SELECT doc_id, lang, source, {DOC_RULES_SQL} AS reject_reason FROM documents""")
def validate_quarantine(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source")
    tagged = ing.validate(d, [
        ("missing_text", ing.required("text")),
        ("bad_lang", ing.in_domain("lang", ["en", "fr", "de", "ko"])),
        ("missing_source", ing.required("source")),
    ])
    return tagged.select("doc_id", "lang", "source", "reject_reason")


@register("text_length_gate", """
SELECT doc_id, length(text) AS n_chars,
       CASE WHEN text IS NULL OR length(text) < 5 THEN 'too_short'
            WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS gate
FROM documents""")
def text_length_gate(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    ing.length_gate("text").alias("gate"))


SALT = "faultline-demo-salt"


@register("salted_hash", f"""
SELECT o_orderkey, substr(sha256(CAST(o_custkey AS VARCHAR) || '{SALT}'), 1, 16) AS ip_hash FROM orders""")
def salted_hash(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", ing.salted_hash("o_custkey", SALT).alias("ip_hash"))


def analysis_requests(spark, sf_dir):
    """documents as save requests (some fields empty/absent on purpose)."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source", "n_chars")
    return d.select(
        "doc_id",
        F.col("text").alias("input_text"),
        F.when(F.col("lang") == "en", F.lit("")).when(F.col("source") == "src3", F.lit("fax")).otherwise(F.lit("mixed")).alias("input_type"),
        (F.col("lang") == "fr").alias("has_pdf"),
        F.when(F.col("lang") == "de", F.col("text")).alias("pdf_text"),
        F.when(F.col("source") != "src5", F.col("source")).alias("diagram_id"),
        F.when(F.col("lang") == "es", F.lit("")).when(F.col("source") == "src9", F.lit("기타")).otherwise(F.lit("차대차")).alias("category"),
        (F.col("n_chars") % 100).cast("int").alias("match_score"),
        F.col("source").alias("session_id"),
        F.when(F.col("lang") != "de", (F.col("n_chars") % 101).cast("int")).alias("fault_a"),
        F.when(F.col("source") != "src7", (100 - F.col("n_chars") % 101).cast("int")).alias("fault_b"),
    )


_ANALYSES_SQL = f"""
req AS (
  SELECT doc_id, text, lang, source, n_chars,
    CASE WHEN lang = 'en' THEN '' WHEN source = 'src3' THEN 'fax' ELSE 'mixed' END AS raw_type,
    CASE WHEN lang = 'es' THEN '' WHEN source = 'src9' THEN '기타' ELSE '차대차' END AS raw_category,
    CASE WHEN source <> 'src5' THEN source END AS diagram_id,
    CASE WHEN lang <> 'de' THEN CAST(n_chars % 101 AS INTEGER) END AS fault_a,
    CASE WHEN source <> 'src7' THEN CAST(100 - n_chars % 101 AS INTEGER) END AS fault_b
  FROM documents
),
rec AS (
  SELECT doc_id,
    substr(coalesce(text, ''), 1, 10000) AS input_text,
    substr(coalesce(CASE WHEN lang = 'de' THEN text END, ''), 1, 20000) AS pdf_text,
    '' AS ocr_text, '' AS analysis_text, '' AS user_agent,
    CASE WHEN raw_type = '' THEN 'text' ELSE raw_type END AS input_type,
    '하' AS confidence, 'A' AS label_a, 'B' AS label_b,
    coalesce(lang = 'fr', false) AS has_pdf, false AS has_image, false AS has_video, false AS llm_used,
    '' AS diagram_title, raw_category AS category, '' AS subcategory,
    '[]' AS alt_diagrams, '[]' AS detected_mods, '[]' AS applied_mods, '[]' AS laws,
    CAST(n_chars % 100 AS INTEGER) AS match_score,
    nullif(source, '') AS session_id, diagram_id, fault_a, fault_b,
    CAST(NULL AS INTEGER) AS base_fault_a, CAST(NULL AS INTEGER) AS base_fault_b,
    substr(sha256('{SALT}'), 1, 16) AS ip_hash,
    CASE WHEN diagram_id IS NULL OR diagram_id = '' THEN 'missing_diagram' WHEN fault_a IS NULL THEN 'missing_fault_a'
         WHEN fault_b IS NULL THEN 'missing_fault_b'
         WHEN raw_type NOT IN ('', 'text', 'pdf', 'ocr', 'video', 'mixed') THEN 'bad_input_type'
         WHEN raw_category NOT IN ('', '차대차', '차대사람', '차대자전거') THEN 'bad_category' END AS reject_reason
  FROM req
)"""


def _analyses(spark, sf_dir):
    rec = ing.shape_analysis_records(analysis_requests(spark, sf_dir), salt=SALT)
    return ing.validate(rec, ing.analysis_rules())


@register("analyses_append", f"WITH {_ANALYSES_SQL} SELECT * EXCLUDE (reject_reason) FROM rec WHERE reject_reason IS NULL")
def analyses_append(spark, sf_dir):
    """The accepted rows are appended with a new id and time, and read back.

    Documents carry no client address, so every row hashes '' + salt; the
    list columns are shown as the JSON the table stores. Ids and times are
    new in every run and left out.
    """
    rows = ing.valid_rows(_analyses(spark, sf_dir))
    names = [c for c in rows.columns]
    root = scratch_path(spark, "tables", "analyses", uuid.uuid4().hex)
    stored = ing.append_returning(rows, root, returning=("id", "created_at", *names))
    stored = stored.where(F.col("id").isNotNull() & F.col("created_at").isNotNull())
    return stored.select(*[F.to_json(c).alias(c) if c in ing.ANALYSIS_LISTS else F.col(c) for c in names])


@register("analyses_quarantine", f"""WITH {_ANALYSES_SQL}
SELECT doc_id, diagram_id, fault_a, fault_b, input_type, category, reject_reason FROM rec WHERE reject_reason IS NOT NULL""")
def analyses_quarantine(spark, sf_dir):
    """The rows the save handler or the table refuses, with the first reason."""
    bad = ing.quarantined_rows(_analyses(spark, sf_dir))
    return bad.select("doc_id", "diagram_id", "fault_a", "fault_b", "input_type", "category", "reject_reason")


# ---------------------------------------------------------------- upsert

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _target(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select(*CUST)


def _source(spark, sf_dir, with_repeats: bool):
    c = _target(spark, sf_dir)
    upd = c.where(F.col("c_mktsegment") == "AUTOMOBILE") \
           .withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("arrival", F.lit(1))
    new = c.where(F.col("c_mktsegment") == "MACHINERY") \
           .withColumn("c_custkey", F.col("c_custkey") + 1000000000) \
           .withColumn("c_name", F.concat("c_name", F.lit(" (new)"))).withColumn("arrival", F.lit(1))
    src = upd.unionByName(new)
    if with_repeats:
        again = c.where((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_nationkey") < 10)) \
                 .withColumn("c_acctbal", F.col("c_acctbal") + 200).withColumn("arrival", F.lit(2))
        src = src.unionByName(again)
    return src


_SRC_SQL = """
src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment, 1 AS arrival
  FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL
  SELECT c_custkey + 1000000000, c_name || ' (new)', c_nationkey, c_acctbal, c_mktsegment, 1
  FROM customer WHERE c_mktsegment = 'MACHINERY'
  {repeats}
),
dedup AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (
    SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY arrival DESC) AS rn FROM src) WHERE rn = 1
),
merged AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer t
  WHERE NOT EXISTS (SELECT 1 FROM dedup s WHERE s.c_custkey = t.c_custkey)
  UNION ALL SELECT * FROM dedup
)"""

_REPEATS_SQL = """UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 200, c_mktsegment, 2
  FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey < 10"""


@register("video_upsert", "WITH " + _SRC_SQL.format(repeats="") + " SELECT * FROM merged")
def video_upsert(spark, sf_dir):
    src = _source(spark, sf_dir, with_repeats=False)
    return ups.upsert(_target(spark, sf_dir), src, "c_custkey", on_duplicate="error")


@register("video_upsert_dedup", "WITH " + _SRC_SQL.format(repeats=_REPEATS_SQL) + " SELECT * FROM merged")
def video_upsert_dedup(spark, sf_dir):
    src = _source(spark, sf_dir, with_repeats=True)
    return ups.upsert(_target(spark, sf_dir), src, "c_custkey", on_duplicate="last", order=["arrival"])


@register("video_upsert_summary", "WITH " + _SRC_SQL.format(repeats=_REPEATS_SQL) + """
SELECT (SELECT count(*) FROM src) AS total_sent, count(*) AS uploaded,
       CAST(count_if(c.c_custkey IS NULL) AS BIGINT) AS inserted,
       CAST(count_if(c.c_custkey IS NOT NULL) AS BIGINT) AS updated
FROM dedup d LEFT JOIN customer c ON d.c_custkey = c.c_custkey""")
def video_upsert_summary(spark, sf_dir):
    src = _source(spark, sf_dir, with_repeats=True)
    written = ups.dedupe_last(src, "c_custkey", ["arrival"])
    return ups.upsert_summary(_target(spark, sf_dir), src, "c_custkey", written=written)


# ------------------------------------------------------ referential checks

@register("fk_orphans", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate < TIMESTAMP '2001-01-01')""")
def fk_orphans(spark, sf_dir):
    """Parent table loaded up to 2000: lineitems of later orders are orphans."""
    t = Tables(spark, sf_dir)
    parent = t.orders.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey")
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return ups.orphans(child, parent, "l_orderkey", "o_orderkey")


@register("cascade_delete", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')""")
def cascade_delete(spark, sf_dir):
    """Delete pending orders; their lineitems go with them."""
    t = Tables(spark, sf_dir)
    deleted = t.orders.where(F.col("o_orderstatus") == "P").select("o_orderkey")
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ups.cascade_delete(child, deleted, "l_orderkey", "o_orderkey")
