"""Tables and functions of the session catalog (K11, F14, U2; P14).

Column defaults are declared once, in the table: an INSERT that names only
some columns gets the others from there, and an explicit NULL stays NULL.
Reports with a parameter are stored as SQL table functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The declared columns, types and defaults of the feedback, precedent and analysis tables.
FEEDBACK_COLUMNS = [("analysis_id", "BIGINT", None), ("created_at", "TIMESTAMP", "current_timestamp()"), ("is_correct", "BOOLEAN", None),
                    ("correct_diagram", "STRING", None), ("comment", "STRING", None), ("expert_level", "STRING", "'user'")]
PRECEDENT_COLUMNS = [("case_number", "STRING", None), ("created_at", "TIMESTAMP", "current_timestamp()"), ("court", "STRING", None), ("fault_a", "INT", None),
                     ("fault_b", "INT", None), ("confidence", "INT", "50"), ("verified", "BOOLEAN", "false"), ("source", "STRING", "'user'")]
ANALYSIS_FLAGS = [("analysis_id", "BIGINT", None), ("created_at", "TIMESTAMP", "current_timestamp()"), ("input_text", "STRING", None),
                  ("input_type", "STRING", "'text'"), ("has_pdf", "BOOLEAN", "false"), ("has_image", "BOOLEAN", "false"), ("has_video", "BOOLEAN", "false"),
                  ("llm_used", "BOOLEAN", "false")]


def create_table(spark: SparkSession, columns: list[tuple[str, str, str | None]], name: str) -> str:
    """A Parquet table with declared defaults, under the shared folder; returns its name in the catalog."""
    table = f"{name}_{uuid.uuid4().hex}"
    declared = ", ".join(f"`{c}` {t}" + (f" DEFAULT {d}" if d is not None else "") for c, t, d in columns)
    spark.sql(f"CREATE TABLE {table} ({declared}) USING parquet LOCATION '{scratch_path(spark, 'tables', table)}'")
    return table


def insert(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """K1: append ``rows``; columns of the table that they lack take their defaults."""
    names = ", ".join(f"`{c}`" for c in rows.columns)
    spark.sql(f"INSERT INTO {table} ({names}) SELECT {names} FROM {{rows}}", rows=rows)


def table_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> str:
    """Store a report as a SQL table function of the session; returns its name, to be called in FROM."""
    function = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY FUNCTION {function}({parameters}) RETURNS TABLE ({returns}) RETURN {body}")
    return function


def store_variant(df: DataFrame, raw: str, path: str, column: str = "raw_json") -> DataFrame:
    """``df`` with the JSON text ``raw`` stored once, as a VARIANT column ``column``; the stored table, read back.

    Text that is no JSON is stored as null. Paths read from the column later
    (``variant_get``) are pushed into the scan, which then reads only these.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.variant.pushVariantIntoScan", "true")
    out = df.withColumn("_parsed", F.try_parse_json(F.col(raw))).drop(*{raw, column}).withColumnRenamed("_parsed", column)
    out.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
