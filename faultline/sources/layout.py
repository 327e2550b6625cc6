"""Table layout in place of the reference's indexes.

B-tree indexes on created_at / diagram_id / session_id become a Parquet
layout: directories by day (partition pruning) and rows sorted by key
inside each file (row-group min/max skipping). The write range-partitions
on (day, key), so a day holding a third of all rows is spread over many
tasks and files instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, time_col: str, keys: list[str], partitions: int | None = None,
                    day_col: str = "day", mode: str = "append") -> str:
    """Write ``df`` partitioned by day and clustered by ``keys``."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    out = df.withColumn(day_col, F.to_date(F.col(time_col)))
    out = out.repartitionByRange(n, F.col(day_col), *[F.col(k) for k in keys])
    out = out.sortWithinPartitions(day_col, *keys)
    out.write.mode(mode).partitionBy(day_col).parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: bool = True,
                   mode: str = "overwrite") -> str:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``key``.

    Two tables bucketed by the same key into the same number of buckets join
    on that key without a shuffle (e.g. lineitem and orders on the order
    key for the FK and cascade checks). Needs a session catalog; the table
    data goes under ``spark.sql.warehouse.dir``.
    """
    w = df.write.mode(mode).bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)
    return table
