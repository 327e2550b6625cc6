"""Model usage ledger and cost summaries (K2, P11-P13, A16; T20)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices per 1,000 tokens used by the handler (USD).
PRICE_IN_PER_1K = Decimal("0.003")
PRICE_OUT_PER_1K = Decimal("0.015")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cost_usd(input_tokens, output_tokens, precision: int = 8, scale: int = 6) -> Column:
    """(in * 0.003 + out * 0.015) / 1000 as DECIMAL(8,6).

    Computed in exact decimals; a value that does not fit the column type
    (>= 100 USD) becomes null instead of failing the job (T20).
    """
    i = F.coalesce(_c(input_tokens), F.lit(0)).cast("decimal(20,0)")
    o = F.coalesce(_c(output_tokens), F.lit(0)).cast("decimal(20,0)")
    raw = (i * F.lit(PRICE_IN_PER_1K) + o * F.lit(PRICE_OUT_PER_1K)) * F.lit(Decimal("0.001"))
    return raw.try_cast(f"decimal({precision},{scale})")


def purpose(mode) -> Column:
    """``mode === 'report' ? 'report' : 'match'``."""
    return F.when(_c(mode) == F.lit("report"), F.lit("report")).otherwise(F.lit("match"))


def ledger(df: DataFrame, input_tokens: str, output_tokens: str, mode: str | None = None) -> DataFrame:
    """K2: ledger rows with totals, cost and a reject flag for overflowing cost."""
    out = df.withColumn("total_tokens", F.coalesce(_c(input_tokens), F.lit(0)) + F.coalesce(_c(output_tokens), F.lit(0)))
    out = out.withColumn("cost_usd", cost_usd(input_tokens, output_tokens))
    out = out.withColumn("cost_rejected", F.col("cost_usd").isNull())
    if mode is not None:
        out = out.withColumn("purpose", purpose(mode))
    return out


def cost_summary(ledger_df: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens and cost per key (e.g. day, model, purpose).

    ``rejected_calls`` counts the calls whose cost does not fit the column
    (T20); ``cost_usd`` is the sum of the others.
    """
    return ledger_df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("cost_usd").isNull()).alias("rejected_calls"),
        F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
    )
