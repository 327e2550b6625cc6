"""Per-diagram accuracy: scoring, the two accuracy definitions, maintenance.

Two accuracy figures exist side by side (T5):

* the *application* counter (``accuracy_by_key``): only rows with a verdict
  count, rate = Math.round(c/t*100*100)/100 on doubles;
* the *database* trigger (``diagram_stats``): every joined feedback row is in
  the denominator, rate = ROUND(c::DECIMAL / n * 100, 2) as DECIMAL(5,2).

All operators are grouped aggregations (partial + final HashAggregate, so a
hot diagram is combined map-side before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import decimal_percent, percent_half_up


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerance_verdict(predicted, actual, tolerance: int = 10) -> Column:
    """``|predicted - actual| <= tol``; null when no actual; false when no prediction."""
    p, a = _c(predicted), _c(actual)
    return F.when(a.isNotNull(), F.coalesce(F.abs(p - a) <= F.lit(tolerance), F.lit(False)))


def score_feedback(df: DataFrame, predicted: str, actual: str, tolerance: int = 10,
                   out: str = "is_correct", modifiers: str | None = None) -> DataFrame:
    """K4 + F10 + P16: add the verdict and default an absent modifier list to []."""
    df = df.withColumn(out, tolerance_verdict(predicted, actual, tolerance))
    if modifiers:
        if modifiers in df.columns:
            df = df.withColumn(modifiers, F.coalesce(F.col(modifiers), F.array().cast("array<string>")))
        else:
            df = df.withColumn(modifiers, F.array().cast("array<string>"))
    return df


def accuracy_by_key(scored: DataFrame, key: str, verdict: str = "is_correct",
                    total: str = "total_count", correct: str = "correct_count",
                    rate: str = "accuracy_rate") -> DataFrame:
    """The application counter, recomputed for the whole feedback set.

    Only rows with a non-empty key and a non-null verdict are counted, which
    is exactly what the incremental counter ends up with after every insert.
    """
    k = F.col(key)
    rows = scored.where(k.isNotNull() & (k != F.lit("")) & F.col(verdict).isNotNull())
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias(total),
                                F.count_if(F.col(verdict)).alias(correct))
    return agg.withColumn(rate, percent_half_up(correct, total))


def diagram_stats(joined: DataFrame, diagram: str, verdict: str = "is_correct",
                  out_key: str = "diagram_id") -> DataFrame:
    """The trigger's upsert rows for every diagram.

    ``joined`` is feedback already joined to analyses (J1). Null verdicts
    count in ``total_matches`` but in neither of the two filtered counts.
    """
    v = F.col(verdict)
    agg = joined.groupBy(F.col(diagram).alias(out_key)).agg(
        F.count(F.lit(1)).cast("int").alias("total_matches"),
        F.count_if(v == F.lit(True)).cast("int").alias("correct_count"),
        F.count_if(v == F.lit(False)).cast("int").alias("incorrect_count"),
    )
    return agg.withColumn("accuracy_pct", decimal_percent("correct_count", "total_matches"))


def touched_analyses(analyses: DataFrame, diagram: str, touched: DataFrame, touched_key: str) -> DataFrame:
    """The analyses whose diagram was touched (left semi join).

    Restrict the analyses side BEFORE joining feedback: the restricted side
    is small, so AQE can broadcast it and the feedback table is never
    shuffled for the join. The touched set is joined, not collected.
    """
    keys = touched.select(F.col(touched_key).alias("_touched")).where(F.col("_touched").isNotNull())
    return analyses.join(keys, F.col(diagram) == F.col("_touched"), "left_semi")


def diagram_stats_touched(joined: DataFrame, diagram: str, touched: DataFrame,
                          touched_key: str, verdict: str = "is_correct",
                          out_key: str = "diagram_id") -> DataFrame:
    """J2 on an already-joined frame: recompute only the touched diagrams.

    When the join is still to be done, apply ``touched_analyses`` to the
    analyses side first instead.
    """
    restricted = touched_analyses(joined, diagram, touched, touched_key)
    return diagram_stats(restricted, diagram, verdict, out_key)


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Order + limit (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def accuracy_merge(state: DataFrame, delta: DataFrame, key: str,
                   total: str = "total_count", correct: str = "correct_count",
                   rate: str = "accuracy_rate") -> DataFrame:
    """Fold new counters into the stored ones (full outer join on key).

    Counters are additive, so state + delta equals a full recompute without
    the read-modify-write race of the request handler (T24).
    """
    s = state.select(F.col(key).alias("_k"), F.col(total).alias("_st"), F.col(correct).alias("_sc"))
    d = delta.select(F.col(key).alias("_k"), F.col(total).alias("_dt"), F.col(correct).alias("_dc"))
    m = s.join(d, "_k", "full_outer")
    out = m.select(
        F.col("_k").alias(key),
        (F.coalesce("_st", F.lit(0)) + F.coalesce("_dt", F.lit(0))).alias(total),
        (F.coalesce("_sc", F.lit(0)) + F.coalesce("_dc", F.lit(0))).alias(correct),
    )
    return out.withColumn(rate, percent_half_up(correct, total))


def running_accuracy(df: DataFrame, by: list[str], order: list[str], verdict: str,
                     bucket: Column, seen: str = "n_seen", ok: str = "n_ok",
                     rate: str = "running_rate") -> DataFrame:
    """Accuracy after each feedback row, per group, in event order.

    A running count over ``partitionBy(by)`` would put a hot group in a
    single task. Instead the order is cut into ``bucket`` chunks (a
    monotone function of the leading order column): counts are prefixed
    inside each (group, chunk), chunk totals are prefixed over the small
    chunk table, and the two are added back -- a two-level prefix sum with
    no unbounded partition. Null groups and null times are kept: a null key
    is a group of its own and null order values come first (T1).
    """
    v = F.col(verdict)
    order = [F.asc_nulls_first(c) for c in order]
    x = df.withColumn("_chunk", bucket) \
          .withColumn("_one", F.lit(1).cast("bigint")) \
          .withColumn("_hit", F.when(v, 1).otherwise(0).cast("bigint"))
    w_in = (Window.partitionBy(*by, "_chunk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_seen_in", F.sum("_one").over(w_in)) \
         .withColumn("_ok_in", F.sum("_hit").over(w_in))
    chunks = x.groupBy(*by, "_chunk").agg(F.sum("_one").alias("_ct"), F.sum("_hit").alias("_ch"))
    w_prev = (Window.partitionBy(*by).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select(*by, "_chunk",
                            F.coalesce(F.sum("_ct").over(w_prev), F.lit(0)).alias("_seen_off"),
                            F.coalesce(F.sum("_ch").over(w_prev), F.lit(0)).alias("_ok_off"))
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_chunk"])], "_seen_off", "_ok_off")
    cond = F.lit(True)
    for i, c in enumerate([*by, "_chunk"]):
        cond = cond & x[c].eqNullSafe(offsets[f"_o{i}"])
    y = x.join(offsets, cond, "inner").drop(*[f"_o{i}" for i in range(len(by) + 1)])
    y = y.withColumn(seen, F.col("_seen_in") + F.col("_seen_off")) \
         .withColumn(ok, F.col("_ok_in") + F.col("_ok_off"))
    y = y.withColumn(rate, percent_half_up(ok, seen))
    return y.drop("_chunk", "_one", "_hit", "_seen_in", "_ok_in", "_seen_off", "_ok_off")


def accuracy_merge_into(spark, root: str, delta: DataFrame, key: str,
                        total: str = "total_count", correct: str = "correct_count",
                        rate: str = "accuracy_rate", batch_id: int | None = None) -> int:
    """K7 persisted: fold a batch of counters into the stored table.

    Reads the current snapshot, merges additively (``accuracy_merge``) and
    creates the next version. The version that is read and the number of the
    new one come from one listing, and a version is only ever created: of two
    writers that read the same version one gets an error and can run again.
    ``batch_id`` numbers the deltas (as ``foreachBatch`` does): a batch up to
    the last one in the table is not added again, so a retry is harmless.
    Returns the current version number.
    """
    from ..sources import snapshots

    vs = snapshots.committed_versions(spark, root)
    if not vs:
        merged = delta.select(key, total, correct).withColumn(rate, percent_half_up(correct, total))
    else:
        cur = snapshots.read_version(spark, root, vs[-1])
        if batch_id is not None and "_last_batch" in cur.columns and not cur.where(F.col("_last_batch") >= batch_id).isEmpty():
            return vs[-1]
        merged = accuracy_merge(cur, delta, key, total, correct, rate)
    if batch_id is not None:
        merged = merged.withColumn("_last_batch", F.lit(batch_id).cast("long"))
    nxt = snapshots.free_version(spark, root, vs[-1] if vs else -1)
    snapshots.create_version(merged, root, nxt)
    return nxt
