"""Latest-per-session, attach-to-latest and as-of attach.

* Latest row per session is ``max_by(row, (ts, id))`` -- a partial
  aggregate, so a session holding a third of the rows is reduced map-side.
* As-of attach (each right row gets the latest left row at or before it)
  is a union of both sides and ``last(ignorenulls)`` over event order --
  linear, no inequality join. To keep a hot session out of a single task
  the timeline is cut into chunks: the window runs per (session, chunk),
  and rows whose chunk has no earlier candidate take the last candidate of
  the preceding chunks, found on the small per-chunk table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import js_string


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The newest row per key (``order`` ascending = older first)."""
    cols = columns or [c for c in df.columns if c != key]
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order])).alias("_r"))
              .select(key, "_r.*"))


def attach_to_latest(results: DataFrame, analyses: DataFrame, session: str, order: list[str],
                     analysis_id: str, out_id: str = "analysis_id") -> DataFrame:
    """J3/K3 (batch): each result row gets the id of its session's latest analysis.

    Sessions without an analysis get no row (the handler answers 404 and
    writes nothing).
    """
    latest = latest_per_key(analyses.select(session, analysis_id, *order), session, order, [analysis_id])
    latest = latest.select(F.col(session).alias("_s"), F.col(analysis_id).alias(out_id))
    return results.join(latest, results[session] == latest["_s"], "inner").drop("_s")


def update_by_key(target: DataFrame, updates: DataFrame, key: str, columns: list[str],
                  order: list[str] | None = None) -> DataFrame:
    """K8: ``UPDATE target SET columns = updates.columns WHERE target.key = updates.key``.

    Matched rows take the update's values -- null included, as an SQL UPDATE
    does; unmatched rows are unchanged. Several updates of one key keep the
    last by ``order`` (a partial ``max_by`` aggregate), so the join never
    multiplies target rows.
    """
    # without an order only equal updates of a key are allowed; VARIANT cannot be ordered, its JSON text can
    types = dict(updates.dtypes)
    rank = [F.col(c) if order or types[c] != "variant" else F.to_json(c) for c in (order or columns)]
    upd = (updates.where(F.col(key).isNotNull()).groupBy(key)
                  .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in columns]), F.struct(*rank)).alias("_u"))
                  .select(F.col(key).alias("_k"), "_u"))
    j = target.join(upd, target[key] == upd["_k"], "left")
    hit = F.col("_k").isNotNull()
    out = [F.when(hit, F.col("_u")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
           for c in target.columns]
    out += [F.when(hit, F.col("_u")[c]).alias(c) for c in columns if c not in target.columns]
    return j.select(*out)


def mark_used(analyses: DataFrame, attached: DataFrame, analysis_id: str, attached_id: str = "analysis_id",
              flag: str = "llm_used", response: str | None = None, order: list[str] | None = None) -> DataFrame:
    """K8: ``UPDATE analyses SET llm_used = true[, llm_response = ...] WHERE id IN (attached)``."""
    if flag not in analyses.columns:  # the column's declared default
        analyses = analyses.withColumn(flag, F.lit(False))
    cols = [F.col(attached_id).alias(analysis_id), F.lit(True).alias(flag), *[F.col(c) for c in order or []]]
    if response:
        cols.append(F.col(response))
    upd = attached.select(*cols)
    return update_by_key(analyses, upd, analysis_id, [flag] + ([response] if response else []), order)


def asof_attach(right: DataFrame, left: DataFrame, by: str, ts: str, left_cols: list[str],
                chunk=None, tiebreak: str | None = None, inclusive: bool = True,
                how: str = "inner", prefix: str = "match_") -> DataFrame:
    """J3 (as-of): each ``right`` row gets the latest ``left`` row with the same
    ``by`` and ``left.ts <= right.ts`` (``<`` when ``inclusive=False``).

    ``chunk`` is a function of the timestamp column giving a monotone bucket
    (e.g. ``lambda c: F.date_trunc('day', c)``); ``tiebreak`` orders left
    rows sharing a timestamp. Matched columns come back as ``prefix + name``.
    """
    bucket = chunk if chunk is not None else (lambda c: F.lit(0))
    tb = tiebreak or ts
    lside, rside = (0, 1) if inclusive else (1, 0)  # candidates first on ties when inclusive
    L = left.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.col(tb).alias("_tb"),
                    F.struct(*[F.col(c).alias(c) for c in left_cols]).alias("_cand"))
    # null keys and times match nothing (``null <= ts`` is not true)
    L = L.where(F.col("_by").isNotNull() & F.col("_ts").isNotNull()).withColumn("_chunk", bucket(F.col("_ts")))
    rcols = right.columns
    alone = right.where(F.col(by).isNull() | F.col(ts).isNull())
    R = (right.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withColumn("_by", F.col(by)).withColumn("_ts", F.col(ts))
              .withColumn("_chunk", bucket(F.col("_ts")))
              .withColumn("_tb", F.lit(None).cast(L.schema["_tb"].dataType))
              .withColumn("_cand", F.lit(None).cast(L.schema["_cand"].dataType)))
    u = (L.withColumn("_side", F.lit(lside)).withColumn("_q", F.lit(None).cast("int"))
          .unionByName(R.withColumn("_side", F.lit(rside)).withColumn("_q", F.lit(1)),
                       allowMissingColumns=True))
    w = (Window.partitionBy("_by", "_chunk").orderBy("_ts", "_side", "_tb")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queries = u.withColumn("_m", F.last("_cand", ignorenulls=True).over(w)).where(F.col("_q") == 1)
    # carry-over: the last candidate of the earlier chunks of the same key,
    # computed on the per-(key, chunk) tables only (derived from the inputs,
    # so the big windowed frame is not evaluated twice)
    carry = L.groupBy("_by", "_chunk").agg(F.max_by("_cand", F.struct("_ts", "_tb")).alias("_last"))
    need = R.select("_by", "_chunk").distinct()
    cand = (carry.withColumn("_kind", F.lit(1))
            .unionByName(need.withColumn("_kind", F.lit(0))
                         .withColumn("_last", F.lit(None).cast(carry.schema["_last"].dataType))))
    w2 = (Window.partitionBy("_by").orderBy("_chunk", "_kind")
          .rowsBetween(Window.unboundedPreceding, -1))
    prev = (cand.withColumn("_prev", F.last("_last", ignorenulls=True).over(w2))
                .where(F.col("_kind") == 0).select("_by", "_chunk", "_prev"))
    j = queries.join(prev, ["_by", "_chunk"], "left").withColumn("_match", F.coalesce("_m", "_prev"))
    if how == "inner":
        j = j.where(F.col("_match").isNotNull())
    out = j.select(*rcols, *[F.col("_match")[c].alias(prefix + c) for c in left_cols])
    if how == "inner":
        return out
    types = dict(left.dtypes)
    return out.unionByName(alone.select(*rcols, *[F.lit(None).cast(types[c]).alias(prefix + c) for c in left_cols]))


def agreement(a, b, numeric: bool = False) -> tuple[Column, Column]:
    """``String(a || '') === String(b || '')`` and a 'both present' flag.

    ``numeric=True`` for numeric id columns, where 0 is falsy.
    """
    sa, sb = js_string(a, numeric), js_string(b, numeric)
    return sa == sb, (sa != F.lit("")) & (sb != F.lit(""))
