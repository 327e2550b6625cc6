"""Small helpers the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch_path


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of the current stage, never
    the stages before the table. Every call takes a folder of its own. ``free``: let
    Spark drop the shuffle files of plans that the driver has forgotten; not worth it
    after a small step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, so that long jobs do not pile them up."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame, size: str = "16m") -> DataFrame:
    """``df``; from now on Arrow batches of its session end at ``size`` bytes, whatever their rows hold."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(id, 64-bit hash of the text): rows that repeat both are one document."""
    return [F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """``a.k <=> b.k`` for every key: a null id joins its own rows."""
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond &= a[k].eqNullSafe(b[k])
    return cond




def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
