"""Table scans (S1) and record ingest (S3).

Scans go through ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the Parquet reader; callers name the columns they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Scan one table; ``columns`` becomes the Parquet ReadSchema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def read_json_records(spark: SparkSession, path: str, column: str = "raw_json") -> DataFrame:
    """Ingest JSON-lines files as one raw string column per record.

    The raw text is kept (P14) and parsed later with ``try_parse_json`` so a
    malformed record becomes a quarantined row, not a failed job.
    """
    return spark.read.text(path).select(F.col("value").alias(column))


def json_array_records(df: DataFrame, body_col: str, key: str = "records",
                       column: str = "raw_json") -> DataFrame:
    """Explode a request body ``{"records": [...]}`` into one row per record."""
    arr = F.try_variant_get(F.try_parse_json(F.col(body_col)), f"$.{key}", "array<variant>")
    return df.select(F.explode(arr).alias("_rec")).select(F.to_json("_rec").alias(column))


def read_json_bodies(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """S3: request bodies as files, one JSON document each, whole as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(column))


V1_SOURCES = "spark.sql.sources.useV1SourceList"
FOOTER_COUNTS = "spark.sql.parquet.aggregatePushdown"


def footer_scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose row count comes from the file footers.

    The table is opened through the DataSource V2 reader, into which an ungrouped
    count (also min and max) is pushed: the scan then shows
    ``PushedAggregation`` and reads no row group. Filters, other aggregates and
    grouped ones read the rows as usual.
    """
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(FOOTER_COUNTS, "true")
    spark.conf.set(V1_SOURCES, ",".join(x for x in before.split(",") if x.strip() != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(V1_SOURCES, before)
