"""Report queries bound to the driver tables.

analyses = events (created_at = ts), feedback = lineitem, video records =
orders, hazard rows = part, violation rows = lineitem flags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as rep
from ..sources.tables import Tables, footer_scan, table_path
from .registry import register

# ---------------------------------------------------------------- overview

@register("overview_counts", """
SELECT (SELECT count(*) FROM events) AS total_analyses,
       (SELECT count(*) FROM lineitem) AS total_feedback""")
def overview_counts(spark, sf_dir):
    """Counts from the file footers."""
    return rep.row_counts(total_analyses=footer_scan(spark, table_path(sf_dir, "events")),
                          total_feedback=footer_scan(spark, table_path(sf_dir, "lineitem")))


@register("recent_analyses", """
SELECT event_id, ts, user_id, event_type, value FROM events
ORDER BY ts DESC NULLS FIRST, event_id DESC NULLS FIRST LIMIT 20""")
def recent_analyses(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return rep.latest(ev, 20, "ts", "event_id", ["event_id", "ts", "user_id", "event_type", "value"])


def _diagram_ids(spark, sf_dir):
    """events as analyses: diagram id = k when even, 'd' || k otherwise."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    did = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("d"), k.cast("string")))
    return ev.select("event_id", "ts", did.alias("diagram_id"))


_IDS_SQL = """
ids AS (
  SELECT event_id, ts,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0
              THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR)
              ELSE 'd' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) END AS diagram_id
  FROM events {sample}
),
freq AS (
  SELECT diagram_id AS id, count(*) AS n_uses, max(ts) AS last_ts,
         regexp_matches(diagram_id, '^(0|[1-9][0-9]{{0,9}})$')
           AND TRY_CAST(diagram_id AS BIGINT) < 4294967295 AS is_index
  FROM ids GROUP BY diagram_id
)
SELECT id, n_uses FROM freq
ORDER BY n_uses DESC, is_index DESC, CASE WHEN is_index THEN TRY_CAST(id AS BIGINT) END ASC NULLS LAST,
         last_ts DESC
LIMIT 10"""


@register("top_diagrams", "WITH " + _IDS_SQL.format(sample=""))
def top_diagrams(spark, sf_dir):
    """A2 + O8 over every analysis."""
    return rep.top_frequencies(_diagram_ids(spark, sf_dir), "diagram_id", 10, ["ts", "event_id"])


@register("top_diagrams_recent", "WITH " + _IDS_SQL.format(
    sample="ORDER BY ts DESC NULLS FIRST, event_id DESC NULLS FIRST LIMIT 100"))
def top_diagrams_recent(spark, sf_dir):
    """The overview's variant, frequencies among the latest 100 analyses."""
    return rep.top_frequencies(_diagram_ids(spark, sf_dir), "diagram_id", 10, ["ts", "event_id"],
                               sample_n=100)


# ------------------------------------------------------------ video stats

def _video_rows(spark, sf_dir):
    """orders as video records: place = priority, type = status.

    rate_a is missing for December orders, rate_b on the first of a month.
    """
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus",
                                            "o_orderpriority", "o_orderdate")
    base = o.o_custkey % 101
    return o.select(
        "o_orderkey",
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("video_name"),
        F.col("o_orderpriority").alias("accident_place"),
        F.col("o_orderstatus").alias("accident_type"),
        F.when(F.month("o_orderdate") != 12, base).alias("rate_a"),
        F.when(F.dayofmonth("o_orderdate") != 1, F.lit(100) - base).alias("rate_b"),
    )


_VIDEO_SQL = """
video AS (
  SELECT o_orderkey, 'v' || CAST(o_orderkey AS VARCHAR) AS video_name,
         o_orderpriority AS accident_place, o_orderstatus AS accident_type,
         CASE WHEN month(o_orderdate) <> 12 THEN o_custkey % 101 END AS rate_a,
         CASE WHEN day(o_orderdate) <> 1 THEN 100 - o_custkey % 101 END AS rate_b
  FROM orders
)"""


@register("place_type_stats", f"""WITH {_VIDEO_SQL}
-- urgent 'F' rows have the place 'x' and the type 'y_F', those of high priority 'x_y' and 'F': one key
, v AS (SELECT rate_a, rate_b, CASE WHEN accident_type = 'F' AND accident_place = '1-URGENT' THEN 'x'
                                    WHEN accident_type = 'F' AND accident_place = '2-HIGH' THEN 'x_y' ELSE accident_place END AS place,
               CASE WHEN accident_type = 'F' AND accident_place = '1-URGENT' THEN 'y_F' ELSE accident_type END AS type FROM video)
SELECT min({{'p': place, 't': type}}).p AS accident_place, min({{'p': place, 't': type}}).t AS accident_type, count(*) AS count,
       CAST(floor(CAST(sum(rate_a) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_a,
       CAST(floor(CAST(sum(coalesce(rate_b, 0)) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_b,
       coalesce(place, 'null') || '_' || coalesce(type, 'null') AS stat_key
FROM v WHERE rate_a IS NOT NULL GROUP BY stat_key""")
def place_type_stats(spark, sf_dir):
    v, place, kind = _video_rows(spark, sf_dir), F.col("accident_place"), F.col("accident_type")
    urgent, high = (kind == "F") & (place == "1-URGENT"), (kind == "F") & (place == "2-HIGH")
    v = v.withColumns({"accident_place": F.when(urgent, F.lit("x")).when(high, F.lit("x_y")).otherwise(place),
                       "accident_type": F.when(urgent, F.lit("y_F")).otherwise(kind)})
    return rep.group_rounded_means(v, ["accident_place", "accident_type"],
                                   {"avg_a": "rate_a", "avg_b": "rate_b"}, null_filter="rate_a",
                                   legacy_key="stat_key")


@register("similar_cases", f"""WITH {_VIDEO_SQL}
SELECT * FROM video
WHERE accident_place = '1-URGENT' AND accident_type = 'F' AND rate_a IS NOT NULL
ORDER BY o_orderkey LIMIT 10""")
def similar_cases(spark, sf_dir):
    return rep.equal_filters_top(_video_rows(spark, sf_dir),
                                 {"accident_place": "1-URGENT", "accident_type": "F"},
                                 ["rate_a"], 10, ["o_orderkey"])


# ------------------------------------------------------------- knowledge

@register("violation_stats", """
SELECT l_returnflag AS violation_type, l_linestatus AS sub_type, count(*) AS cnt,
       GROUPING(l_returnflag) = 1 AS is_total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def violation_stats(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_returnflag", "l_linestatus")
    out = rep.counts_with_total(li, ["l_returnflag", "l_linestatus"])
    return out.select(F.col("l_returnflag").alias("violation_type"),
                      F.col("l_linestatus").alias("sub_type"), "cnt", "is_total")


def _hazard_rows(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_type", "p_size")
    defect = (F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
              .when(F.col("p_size") % 2 == 0, F.lit("Y")).otherwise(F.lit("N")))
    return p.select("p_partkey", F.col("p_name").alias("label"),
                    F.col("p_type").alias("category"), defect.alias("is_defect"))


_HAZARD_SQL = """
hazard AS (
  SELECT p_partkey, p_name AS label, p_type AS category,
         CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS is_defect
  FROM part {where} {sample}
)
SELECT label, min_by(category, p_partkey) AS category, count(*) AS count,
       CAST(count_if(coalesce(is_defect = 'Y', false)) AS BIGINT) AS defect_count
FROM hazard GROUP BY label"""


@register("hazard_stats", "WITH " + _HAZARD_SQL.format(where="", sample=""))
def hazard_stats(spark, sf_dir):
    return rep.label_stats(_hazard_rows(spark, sf_dir), "label", "category", "is_defect", "p_partkey")


@register("hazard_stats_keyword", "WITH " + _HAZARD_SQL.format(where="WHERE p_name ILIKE '%RING%'", sample=""))
def hazard_stats_keyword(spark, sf_dir):
    return rep.label_stats(_hazard_rows(spark, sf_dir), "label", "category", "is_defect", "p_partkey",
                           keyword="RING")


@register("hazard_stats_sample", "WITH " + _HAZARD_SQL.format(
    where="", sample="ORDER BY p_partkey ASC NULLS LAST LIMIT 50"))
def hazard_stats_sample(spark, sf_dir):
    """The handler's variant: counts over the first 50 rows."""
    return rep.label_stats(_hazard_rows(spark, sf_dir), "label", "category", "is_defect", "p_partkey",
                           sample_n=50)


def _sensor_rows(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select("event_type", "user_id", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(F.col("event_type").alias("fault_category"),
                     F.concat(F.lit("t"), (k % 5).cast("string")).alias("fault_type"),
                     F.col("user_id").cast("string").alias("sensor_name"))


_SENSOR_SQL = """
SELECT event_type AS fault_category,
       't' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS fault_type,
       count(*) AS count
FROM events {where} GROUP BY ALL"""


@register("sensor_fault_stats", _SENSOR_SQL.format(where=""))
def sensor_fault_stats(spark, sf_dir):
    return rep.composite_counts(_sensor_rows(spark, sf_dir), "fault_category", "fault_type")


@register("sensor_fault_stats_sensor", _SENSOR_SQL.format(where="WHERE CAST(user_id AS VARCHAR) = '7'"))
def sensor_fault_stats_sensor(spark, sf_dir):
    rows = _sensor_rows(spark, sf_dir).where(F.col("sensor_name") == F.lit("7"))
    return rep.composite_counts(rows, "fault_category", "fault_type")


@register("category_lookup", """
SELECT p_partkey, p_type AS tier, p_name AS code FROM part WHERE p_type = 'SMALL'
ORDER BY code ASC NULLS LAST, p_partkey""")
def category_lookup(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_type").alias("tier"),
                                          F.col("p_name").alias("code"))
    return rep.lookup_sorted(p, "tier", "SMALL", "code", "p_partkey", default="1st")


@register("category_lookup_default", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '1st' WHEN 'PROMO' THEN '' ELSE p_type END AS tier, p_name AS code FROM part WHERE p_type = 'SMALL'
ORDER BY code ASC NULLS LAST, p_partkey""")
def category_lookup_default(spark, sf_dir):
    """the lookup without its argument takes the default."""
    tier = F.when(F.col("p_type") == "SMALL", "1st").when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))
    p = Tables(spark, sf_dir).part.select("p_partkey", tier.alias("tier"), F.col("p_name").alias("code"))
    return rep.lookup_sorted(p, "tier", None, "code", "p_partkey", default="1st")


# ------------------------------------------------------------ fault ratios

def _ratios(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_type", "p_size")
    a = F.col("p_size") * 2
    b = F.when(F.col("p_type") == F.lit("PROMO"), F.lit(101) - a).otherwise(F.lit(100) - a)
    return p.select("p_partkey", a.alias("fault_a"), b.alias("fault_b"))


@register("fault_ratio_histogram", """
SELECT CAST(p_size * 2 AS VARCHAR) || ':' || CAST(100 - p_size * 2 AS VARCHAR) AS ratio, count(*) AS cases
FROM part GROUP BY 1 ORDER BY cases DESC, ratio ASC LIMIT 5""")
def fault_ratio_histogram(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select((F.col("p_size") * 2).alias("fault_a"),
                                          (F.lit(100) - F.col("p_size") * 2).alias("fault_b"))
    return rep.ratio_histogram(p, "fault_a", "fault_b", top_n=5)


@register("fault_sum_check", """
SELECT p_partkey, p_size * 2 AS fault_a,
       CASE WHEN p_type = 'PROMO' THEN 101 - p_size * 2 ELSE 100 - p_size * 2 END AS fault_b,
       p_size * 2 + CASE WHEN p_type = 'PROMO' THEN 101 - p_size * 2 ELSE 100 - p_size * 2 END AS fault_sum
FROM part
WHERE p_size * 2 + CASE WHEN p_type = 'PROMO' THEN 101 - p_size * 2 ELSE 100 - p_size * 2 END <> 100""")
def fault_sum_check(spark, sf_dir):
    return rep.fault_sum_violations(_ratios(spark, sf_dir), "fault_a", "fault_b")
