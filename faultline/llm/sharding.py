"""Sharding by sampled splitters: equal bytes per shard, equal texts together.

Rows are ordered by a 64-bit key (high bits from the text, low bits from the id).
A size-weighted sample of the keys gives quantile boundaries; the boundaries cut the
order into many small ranges, one task each. Exact sums per range then place every
row in the global order, and the order is cut into shards of equal bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LOW_BITS = 24
SAMPLES_PER_RANGE = 40


def _splitters(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Quantiles of the sampled keys, moved to the start of a text's keys.

    A text that holds two boundaries or more is heavier than a range: its
    boundaries stay inside it, so the overfull range is subdivided.
    """
    if len(keys) == 0:
        return keys
    cut = np.unique(np.sort(keys)[(np.arange(1, n_ranges) * len(keys)) // n_ranges])
    head = cut >> LOW_BITS
    alone = np.ones(len(cut), bool)
    alone[1:] &= head[1:] != head[:-1]
    alone[:-1] &= head[1:] != head[:-1]
    starts = np.unique(head) << LOW_BITS
    return np.unique(np.concatenate([cut[~alone], starts]))


def keyed_ranges(docs: DataFrame, id_col: str, text_col: str, overhead: int,
                 n_shards: int, ranges_per_shard: int, rows_per_range: int) -> tuple[DataFrame, int, int]:
    """Rows with ``key`` and ``range`` (written), the total size, and the range count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
        F.xxhash64(F.lit(2), F.col(id_col)).alias("h3"))
    low = (1 << LOW_BITS) - 1
    rows = rows.withColumn("key", F.col("h1").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("h3").bitwiseAND(F.lit(low))))
    rows = written(rows, "shard-keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(n_shards * ranges_per_shard, -(-n // rows_per_range))
    want = n_ranges * SAMPLES_PER_RANGE
    # One draw per row: it is taken with a chance in proportion to its size, and a row
    # larger than the step is taken once for every step it covers (64 at most: it is
    # then a range of its own anyway). The draw is a hash, so a retry draws the same.
    step = max(total / want, 1e-9)
    u = F.pmod(F.xxhash64(F.lit(3), "h1", "h3"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.least(F.floor(F.col("size") / F.lit(step) + u), F.lit(64)).cast("int")
    sample = rows.select("key", times.alias("times")).where("times > 0").toPandas()  # about `want` rows
    cut = _splitters(np.repeat(sample["key"].to_numpy("int64"), sample["times"].to_numpy()), n_ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, key.to_numpy("int64"), side="right").astype("int32"))

    return rows.withColumn("range", range_of("key")), total, len(cut) + 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 8, ranges_per_shard: int = 64, rows_per_range: int = 500_000) -> DataFrame:
    """Return ``doc_id, size, text_crc32, shard, slot`` for every row.

    ``size`` is the UTF-8 length of the text (null: none) plus ``overhead``. Shards
    hold near equal sizes: a row lies in the shard that the middle of its unit reaches
    in the global order. A unit is all rows of one text, or, of a text that is heavier
    than a range (1 / ``ranges_per_shard`` of a shard), its part in one range; so a
    shard's size is off by little more than that, or by one long text. Equal texts
    share a shard unless they are heavier than a range; then they fill neighbouring
    places of the order. ``slot`` numbers a shard's rows from 0 without gaps in the
    order of text hash and id.

    Nulls: a null text has size ``overhead`` and CRC 0; null ids order first. An empty
    table gives an empty result. Rows that repeat id and text are all placed. Other
    columns of ``docs`` are ignored.
    """
    rows, total, n_ranges = keyed_ranges(docs, id_col, text_col, overhead, n_shards, ranges_per_shard, rows_per_range)
    rows = written(rows, "shard-ranges")
    spark = docs.sparkSession
    before, seen, done = {}, 0, 0
    for r, size, n in rows.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).orderBy("range").toLocalIterator():
        before[r] = (seen, done)  # a row per range: as many as there are splitters
        seen, done = seen + size, done + n
    offsets = spark.createDataFrame([(r, s, n) for r, (s, n) in before.items()], "range int, size_before long, rows_before long")
    unit = Window.partitionBy("range", "h1", "h2")
    order = Window.partitionBy("range").orderBy("h1", "h2")
    line = Window.partitionBy("range").orderBy("h1", "h2", "doc_id", "h3")
    placed = (rows.withColumns({"upto": F.sum("size").over(order), "unit_size": F.sum("size").over(unit),
                                "at": F.row_number().over(line)})
              .join(F.broadcast(offsets), "range")  # one small row per splitter
              .withColumn("middle", F.col("size_before") + F.col("upto") - F.col("unit_size") / 2)
              .withColumn("shard", F.least(F.floor(F.col("middle") * n_shards / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("at") - 1).alias("rank")))
    placed = written(placed, "shard-places", free=False)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return (placed.join(F.broadcast(first), "shard")  # n_shards rows
            .select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one folder per shard, rows in slot order within each file."""
    places = shard_by_bytes(docs.select(id_col, text_col), n_shards, id_col, text_col).select(
        F.col("doc_id").alias("_place_id"), F.col("text_crc32").alias("_place_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    places = places.dropDuplicates(["_place_id", "_place_crc"])  # rows that repeat id and text share a shard folder
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    (docs.withColumn("_crc", crc)
     .join(places, F.col(id_col).eqNullSafe(F.col("_place_id")) & (F.col("_crc") == F.col("_place_crc")))
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .drop("_place_id", "_place_crc", "_crc", "_slot")
     .write.partitionBy("_shard").parquet(path))
