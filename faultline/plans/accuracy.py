"""Accuracy family bound to the driver tables.

Binding (SURVEY 7.4): feedback = lineitem, analyses = part, joined on the
part key. diagram = p_brand, predicted = l_quantity, actual = p_size, with
the actual absent where l_returnflag = 'N' (the null-verdict case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import time_chunker
from ..operators import accuracy as acc
from ..sources.tables import Tables
from .registry import register

# feedback CTE shared by the oracle SQL of this module
FEEDBACK_SQL = """
feedback AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate,
         p.p_brand AS knia_diagram,
         CAST(l.l_quantity AS INTEGER) AS predicted_fault_a,
         CASE WHEN l.l_returnflag <> 'N' THEN p.p_size END AS actual_fault_a
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
scored AS (
  SELECT *, CASE WHEN actual_fault_a IS NOT NULL
                 THEN coalesce(abs(predicted_fault_a - actual_fault_a) <= 10, false) END AS is_correct
  FROM feedback
)"""

ACCURACY_SQL = """
SELECT knia_diagram, count(*) AS total_count, CAST(count_if(is_correct) AS BIGINT) AS correct_count,
       floor(count_if(is_correct)::DOUBLE / count(*) * 100.0 * 100.0 + 0.5) / 100.0 AS accuracy_rate
FROM scored
WHERE knia_diagram IS NOT NULL AND knia_diagram <> '' AND is_correct IS NOT NULL
GROUP BY knia_diagram"""

STATS_SQL = """
SELECT knia_diagram AS diagram_id,
       CAST(count(*) AS INTEGER) AS total_matches,
       CAST(count_if(is_correct = true) AS INTEGER) AS correct_count,
       CAST(count_if(is_correct = false) AS INTEGER) AS incorrect_count,
       CAST(CAST((count_if(is_correct = true) * 20000 + count(*)) // (2 * count(*)) AS DECIMAL(18,0))
            * 0.01 AS DECIMAL(5,2)) AS accuracy_pct
FROM scored GROUP BY knia_diagram"""


def feedback(spark: SparkSession, sf_dir: str, analyses: DataFrame | None = None) -> DataFrame:
    """lineitem ⋈ part shaped as feedback rows (J1 join, pruned scans)."""
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                           "l_returnflag", "l_shipdate")
    pt = analyses if analyses is not None else t.part.select("p_partkey", "p_brand", "p_size")
    j = li.join(pt, li.l_partkey == pt.p_partkey, "inner")
    return j.select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        F.col("p_brand").alias("knia_diagram"),
        F.col("l_quantity").cast("int").alias("predicted_fault_a"),
        F.when(F.col("l_returnflag") != F.lit("N"), F.col("p_size")).alias("actual_fault_a"),
    )


def scored(spark, sf_dir) -> DataFrame:
    return acc.score_feedback(feedback(spark, sf_dir), "predicted_fault_a", "actual_fault_a")


@register("accuracy_by_diagram", f"WITH {FEEDBACK_SQL} {ACCURACY_SQL}")
def accuracy_by_diagram(spark, sf_dir):
    return acc.accuracy_by_key(scored(spark, sf_dir), "knia_diagram")


@register("feedback_scored", f"""WITH {FEEDBACK_SQL}
SELECT l_orderkey, l_linenumber, knia_diagram, predicted_fault_a, actual_fault_a, is_correct,
       CAST(len(CAST([] AS VARCHAR[])) AS INTEGER) AS n_modifiers
FROM scored""")
def feedback_scored(spark, sf_dir):
    df = acc.score_feedback(feedback(spark, sf_dir), "predicted_fault_a", "actual_fault_a",
                            modifiers="modifiers_applied")
    return df.select("l_orderkey", "l_linenumber", "knia_diagram", "predicted_fault_a",
                     "actual_fault_a", "is_correct", F.size("modifiers_applied").cast("int").alias("n_modifiers"))


@register("diagram_stats", f"WITH {FEEDBACK_SQL} {STATS_SQL}")
def diagram_stats(spark, sf_dir):
    return acc.diagram_stats(scored(spark, sf_dir), "knia_diagram")


@register("diagram_stats_top", f"""WITH {FEEDBACK_SQL}, stats AS ({STATS_SQL})
SELECT * FROM stats ORDER BY total_matches DESC NULLS FIRST, diagram_id ASC LIMIT 50""")
def diagram_stats_top(spark, sf_dir):
    stats = acc.diagram_stats(scored(spark, sf_dir), "knia_diagram")
    return acc.top_by(stats, 50, F.desc_nulls_first("total_matches"), F.asc("diagram_id"))


@register("diagram_stats_touched", f"""WITH {FEEDBACK_SQL}
{STATS_SQL.replace('FROM scored GROUP BY', 'FROM scored WHERE knia_diagram IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY')}""")
def diagram_stats_touched(spark, sf_dir):
    """Touched = brands of parts with p_size = 1; part is restricted before the join."""
    part = Tables(spark, sf_dir).part
    touched = part.where(F.col("p_size") == 1).select("p_brand")
    analyses = acc.touched_analyses(part.select("p_partkey", "p_brand", "p_size"), "p_brand", touched, "p_brand")
    fb = acc.score_feedback(feedback(spark, sf_dir, analyses), "predicted_fault_a", "actual_fault_a")
    return acc.diagram_stats(fb, "knia_diagram")


@register("accuracy_leaderboard", f"""WITH {FEEDBACK_SQL} {ACCURACY_SQL}
ORDER BY accuracy_rate DESC NULLS FIRST, knia_diagram ASC""")
def accuracy_leaderboard(spark, sf_dir):
    """O2: every diagram, highest rate first, nulls first as in the database."""
    rows = acc.accuracy_by_key(scored(spark, sf_dir), "knia_diagram")
    return rows.orderBy(F.desc_nulls_first("accuracy_rate"), F.asc("knia_diagram"))


@register("accuracy_merge", f"WITH {FEEDBACK_SQL} {ACCURACY_SQL}")
def accuracy_merge(spark, sf_dir):
    """State = feedback shipped before 1999, delta = the rest; merged == recompute."""
    s = scored(spark, sf_dir)
    cut = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    state = acc.accuracy_by_key(s.where(cut), "knia_diagram")
    delta = acc.accuracy_by_key(s.where(~cut), "knia_diagram")
    return acc.accuracy_merge(state, delta, "knia_diagram")


# Null groups (values above 450) and null times (values below 2) are part of the data.
EVENTS_WITH_NULLS_SQL = """
ev AS (SELECT event_id, user_id, value, event_type AS kind,
              CASE WHEN value <= 450 THEN event_type END AS event_type, CASE WHEN value >= 2 THEN ts END AS ts FROM events)"""


@register("running_accuracy", f"""WITH {EVENTS_WITH_NULLS_SQL}
SELECT event_id, event_type, ts, value <= 100 AS ok,
       count(*) OVER w AS n_seen,
       CAST(sum(CASE WHEN value <= 100 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_ok,
       floor(CAST(sum(CASE WHEN value <= 100 THEN 1 ELSE 0 END) OVER w AS DOUBLE)
             / count(*) OVER w * 100.0 * 100.0 + 0.5) / 100.0 AS running_rate
FROM ev
WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_accuracy(spark, sf_dir):
    """W3 on events: a row is 'correct' when value <= 100; time chunks sized from the data."""
    ev = Tables(spark, sf_dir).events.select("event_id", "event_type", "ts", "value")
    ev = ev.withColumns({"event_type": F.when(F.col("value") <= 450, F.col("event_type")),
                         "ts": F.when(F.col("value") >= 2, F.col("ts")), "ok": F.col("value") <= F.lit(100)})
    bucket = time_chunker(ev, "ts")(F.col("ts"))
    out = acc.running_accuracy(ev, ["event_type"], ["ts", "event_id"], "ok", bucket)
    return out.select("event_id", "event_type", "ts", "ok", "n_seen", "n_ok", "running_rate")
