"""Report operators: counts, top-k lists, grouped statistics.

The request handlers pulled rows and looped over them in JavaScript; here
every report is a grouped aggregation (partial aggregate before the shuffle,
so a key holding a third of the rows is combined map-side) or an
order+limit (per-partition top-n, then a bounded merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import half_up_round
from ..functions.text import ilike_contains


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_counts(**tables: DataFrame) -> DataFrame:
    """Exact row counts of several tables in one row.

    The first table is aggregated directly; the others are scalar
    subqueries, so no join of any kind is planned.
    """
    names = list(tables)
    first = tables[names[0]].agg(F.count(F.lit(1)).alias(names[0]))
    extra = [tables[n].agg(F.count(F.lit(1))).scalar().alias(n) for n in names[1:]]
    return first.select(names[0], *extra)


def latest(df: DataFrame, n: int, ts: str, tiebreak: str, columns: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows (database order: DESC puts nulls first)."""
    out = df.orderBy(F.desc_nulls_first(ts), F.desc_nulls_first(tiebreak)).limit(n)
    return out.select(*columns) if columns else out


def js_object_key_order(key: Column) -> tuple[Column, Column]:
    """Sort keys reproducing JavaScript object key order.

    Integer-like keys (canonical decimal, below 2^32-1) come first in
    ascending numeric order; the others keep insertion order.
    """
    k = key.cast("string")
    is_index = k.rlike(r"^(0|[1-9][0-9]{0,9})$") & (k.try_cast("bigint") < F.lit(4294967295))
    return is_index, F.when(is_index, k.try_cast("bigint"))


def top_frequencies(df: DataFrame, key: str, n: int, seen_order: list[str],
                    sample_n: int | None = None, out_key: str = "id",
                    out_count: str = "n_uses") -> DataFrame:
    """A2 + O8 (+ A12): top ``n`` keys by frequency with the handler's tie order.

    ``seen_order`` is the order the handler iterated rows in (newest first),
    given as columns sorted descending; a key is "first seen" at its newest
    row. ``sample_n`` reproduces the limit that preceded the count (T2);
    None counts the whole table.
    """
    rows = df
    if sample_n is not None:
        rows = rows.orderBy(*[F.desc_nulls_first(c) for c in seen_order]).limit(sample_n)
    seen = F.struct(*[F.col(c) for c in seen_order])
    freq = rows.groupBy(F.col(key).alias(out_key)).agg(
        F.count(F.lit(1)).alias(out_count), F.max(seen).alias("_first_seen"))
    is_index, index_val = js_object_key_order(F.col(out_key))
    ordered = freq.orderBy(F.desc(out_count), is_index.desc(), index_val.asc_nulls_last(),
                           F.desc("_first_seen"))
    return ordered.limit(n).select(out_key, out_count)


def group_rounded_means(df: DataFrame, keys: list[str], mean_cols: dict[str, str],
                        null_filter: str | None = None, legacy_key: str | None = None,
                        count_col: str = "count") -> DataFrame:
    """A3: count and Math.round-ed means per group.

    Rows are restricted to ``null_filter`` not null; any other null input
    adds 0 to its sum but still counts in the divisor, as ``sum += null``
    does in JavaScript. ``legacy_key`` groups by the handler's string
    key ``${a}_${b}`` (null prints as 'null') under that name: pairs whose keys
    collide (``a_b`` + ``c`` and ``a`` + ``b_c``) are one row, which carries
    the smallest pair.
    """
    rows = df.where(F.col(null_filter).isNotNull()) if null_filter else df
    aggs = [F.count(F.lit(1)).alias(count_col)]
    aggs += [F.sum(F.coalesce(F.col(src), F.lit(0))).alias(f"_sum_{out}") for out, src in mean_cols.items()]
    if legacy_key:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
        g = rows.groupBy(F.concat_ws("_", *parts).alias(legacy_key)).agg(F.min(F.struct(*keys)).alias("_pair"), *aggs)
        g = g.select(*[F.col("_pair")[k].alias(k) for k in keys], *[c for c in g.columns if c != "_pair"])
    else:
        g = rows.groupBy(*keys).agg(*aggs)
    for out in mean_cols:
        g = g.withColumn(out, half_up_round(F.col(f"_sum_{out}") / F.col(count_col)).cast("bigint"))
    return g.drop(*[f"_sum_{out}" for out in mean_cols])


def counts_with_total(df: DataFrame, keys: list[str], count_col: str = "cnt",
                      total_flag: str = "is_total") -> DataFrame:
    """S5 + A11 + K9: counts per key combination plus the grand total row.

    The rows are counted once and the total sums the counts, so ``GROUPING
    SETS`` expands the few groups and not the table. ``total_flag`` marks the
    total row so a null key is never mistaken for it.
    """
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias(count_col), F.grouping(keys[0]).alias("_g"))
    return g.withColumn(total_flag, F.col("_g") == F.lit(1)).drop("_g")


def label_stats(df: DataFrame, label: str, attr: str, flag: str, order_key: str,
                flag_value: str = "Y", keyword: str | None = None,
                sample_n: int | None = None) -> DataFrame:
    """A4 + A5 + F11 (+ F3, A12): count and flagged count per label.

    ``attr`` is reported as first seen -- ``min_by(attr, order_key)`` -- so it
    is deterministic (T19). ``keyword`` is a case-insensitive substring
    filter with SQL wildcards kept (T12); ``sample_n`` takes the first rows
    by ``order_key`` before counting, as the handler's limit did.
    """
    rows = df
    if keyword is not None:
        rows = rows.where(ilike_contains(label, keyword))
    if sample_n is not None:
        rows = rows.orderBy(F.asc_nulls_last(order_key)).limit(sample_n)
    return rows.groupBy(label).agg(
        F.min_by(F.col(attr), F.col(order_key)).alias(attr),
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.coalesce(F.col(flag) == F.lit(flag_value), F.lit(False))).alias("defect_count"),
    )


def composite_counts(df: DataFrame, a: str, b: str, legacy_key: bool = False,
                     count_col: str = "count") -> DataFrame:
    """Count per (a, b), keeping both parts (T4).

    ``legacy_key=True`` groups by the handler's string ``${a}_${b}`` instead,
    where ('a_b','c') and ('a','b_c') collide; the parts are then those of
    the smallest row in (a, b) order.
    """
    if not legacy_key:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias(count_col))
    key = F.concat_ws("_", F.coalesce(F.col(a).cast("string"), F.lit("null")),
                      F.coalesce(F.col(b).cast("string"), F.lit("null")))
    g = df.groupBy(key.alias("_key")).agg(
        F.min(F.struct(F.col(a), F.col(b))).alias("_parts"), F.count(F.lit(1)).alias(count_col))
    return g.select(F.col("_parts")[a].alias(a), F.col("_parts")[b].alias(b), count_col)


def ratio_histogram(df: DataFrame, a: str, b: str, top_n: int | None = 5,
                    out: str = "ratio", count_col: str = "cases") -> DataFrame:
    """Cases per 'A:B' fault ratio, most frequent first."""
    ratio = F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))
    g = df.groupBy(ratio.alias(out)).agg(F.count(F.lit(1)).alias(count_col))
    if top_n is None:
        return g
    return g.orderBy(F.desc(count_col), F.asc(out)).limit(top_n)


def fault_sum_violations(df: DataFrame, a: str, b: str, total: int = 100,
                         out: str = "fault_sum") -> DataFrame:
    """Rows whose two fault shares do not add up to ``total`` (or are missing)."""
    s = F.col(a) + F.col(b)
    return df.withColumn(out, s).where(s.isNull() | (s != F.lit(total)))


def lookup_sorted(df: DataFrame, key_col: str, key_value, order_col: str,
                  tiebreak: str, default=None) -> DataFrame:
    """F1 + F9 + O1: rows with ``key_col = value or default``, sorted ascending.

    Ascending order puts nulls last, as the database does.
    """
    v = key_value if key_value not in (None, "") else default
    return df.where(F.col(key_col) == F.lit(v)).orderBy(F.asc_nulls_last(order_col), F.asc(tiebreak))


def equal_filters_top(df: DataFrame, equals: dict, not_null: list[str], n: int,
                      order: list[str]) -> DataFrame:
    """F1 + F2 + O7: equality and not-null filters, then ``n`` rows in key order."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    for k in not_null:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).orderBy(*[F.asc(c) for c in order]).limit(n)


def envelope(df: DataFrame, max_rows: int, *order: Column, count_col: str = "count",
             results_col: str = "results") -> DataFrame:
    """K9: ``{count, results}`` for a bounded answer (a top-k list).

    The rows are cut to ``max_rows`` by ``order`` first, so at most that many
    rows are gathered into the one-row envelope; the JSON array keeps the
    order.
    """
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(max_rows)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    packed = F.struct(F.col("_rank"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    agg = ranked.agg(F.count(F.lit(1)).alias(count_col), F.sort_array(F.collect_list(packed)).alias("_items"))
    return agg.select(count_col, F.to_json(F.transform("_items", lambda x: x["_row"])).alias(results_col))
