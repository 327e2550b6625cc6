"""Time chunks for windowed operators (two-level prefix sums, as-of attach).

A chunk is a monotone function of the event time. Its width is chosen from
bounded aggregates of the data so that even the densest part of the
timeline gives chunks of at most about ``rows_per_chunk`` rows. The chunk
count therefore grows with the data, and no window partition grows with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def time_chunker(df: DataFrame, ts: str, rows_per_chunk: int = 2_000_000, base_us: int = 1_000_000):
    """Return ``f(ts_column) -> chunk id`` sized for ``df``.

    Rows are counted per time unit (``base_us``) with data, once; then the widest
    width on a doubling ladder whose fullest bucket holds at most
    ``rows_per_chunk`` rows is found by halving: wider buckets are never
    emptier, so some five sums over those counts tell. So the densest part of the
    timeline decides: an hour holding a third of all rows is cut into as
    many chunks as it needs, and a stray date (year 9999) only adds an empty
    stretch. Only a single unit holding more than ``rows_per_chunk`` rows can
    exceed the target. Where all rows together are no more than that, the
    widest width holds them and nothing else has to be counted.

    Null times have a chunk of their own before all others (they sort first).

    ``df`` should be the union of everything the chunk function will be
    applied to (e.g. both sides of an as-of join) -- only its time column is
    read. The driver gets one number from each job.
    """
    spark = df.sparkSession
    t = df.select(_micros(F.col(ts)).alias("_t")).where(F.col("_t").isNotNull())
    n, lo, hi = t.agg(F.count(F.lit(1)), F.coalesce(F.min("_t"), F.lit(0)), F.coalesce(F.max("_t"), F.lit(0))).first()
    fits = ((hi - lo) // base_us).bit_length()  # at this width all rows are in one bucket
    if n > rows_per_chunk:
        path = scratch_path(spark, "chunks", uuid.uuid4().hex)
        t.select(F.floor((F.col("_t") - F.lit(lo)) / F.lit(base_us)).alias("_r")).groupBy("_r").agg(F.count(F.lit(1)).alias("_c")).write.parquet(path)
        per = spark.read.parquet(path)
        fits, fails = 0, fits
        while fails - fits > 1:
            mid = (fits + fails) // 2
            peak = per.groupBy(F.shiftright("_r", mid)).agg(F.sum("_c").alias("_m")).agg(F.max("_m")).first()[0]
            fits, fails = (mid, fails) if peak <= rows_per_chunk else (fits, mid)
    width = base_us * 2 ** fits
    return lambda c: F.coalesce(F.floor((_micros(c) - F.lit(lo)) / F.lit(width)), F.lit(-1)).cast("long")
