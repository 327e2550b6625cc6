"""Column expressions reproducing the request-handler value semantics.

Each helper returns a ``Column`` built from built-in functions, so it stays
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up_round(x, digits: int = 0) -> Column:
    """``Math.round(x * 10^d) / 10^d`` on doubles: floor(x + 0.5)."""
    x = _c(x).cast("double")
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent_half_up(num, den) -> Column:
    """``Math.round((num/den) * 100 * 100) / 100`` in the same operation order."""
    q = _c(num).cast("double") / _c(den).cast("double")
    return F.floor(q * F.lit(100.0) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def decimal_percent(num, den, precision: int = 5, scale: int = 2) -> Column:
    """``ROUND(num::DECIMAL / den * 100, 2)`` as DECIMAL(p,s); 0 when den is 0.

    Non-negative counts only. Computed in exact integer arithmetic --
    floor((num * 100 * 10^s) / den + 1/2) -- so there is one rounding step,
    half away from zero, and no decimal-division precision loss even for
    very large counts.
    """
    from decimal import Decimal

    n, d = _c(num).cast("decimal(38,0)"), _c(den).cast("decimal(38,0)")
    unit = 100 * 10 ** scale
    q = n * F.lit(2 * unit) + d
    two_d = d * F.lit(2)
    steps = ((q - F.pmod(q, two_d)) / two_d).cast("decimal(38,0)")  # exact: divisible
    pct = steps * F.lit(Decimal(1).scaleb(-scale))
    return F.when(d > 0, pct.try_cast(f"decimal({precision},{scale})")) \
        .otherwise(F.lit(0).cast(f"decimal({precision},{scale})"))


def falsy_default(x, default, dtype=None) -> Column:
    """``x || default``: '', 0, false and null all fall back."""
    x = _c(x)
    d = default if isinstance(default, Column) else F.lit(default)
    if dtype is None or isinstance(dtype, StringType):
        falsy = x.isNull() | (x.cast("string") == F.lit(""))
    elif isinstance(dtype, BooleanType):
        falsy = x.isNull() | (~x)
    elif isinstance(dtype, NumericType):
        falsy = x.isNull() | (x == F.lit(0)) | F.isnan(x.cast("double"))
    elif isinstance(dtype, ArrayType):
        # arrays (even empty ones) are truthy in the request handlers
        falsy = x.isNull()
    else:
        falsy = x.isNull()
    return F.when(falsy, d).otherwise(x)


def falsy_to_null(x, dtype=None) -> Column:
    """``x || null``."""
    return falsy_default(x, F.lit(None), dtype)


def nullish_default(*cols) -> Column:
    """``a ?? b ?? null``: first non-null."""
    return F.coalesce(*[_c(c) for c in cols])


def truthy(x) -> Column:
    """``!!x`` for a boolean column: null becomes false."""
    return F.coalesce(_c(x).cast("boolean"), F.lit(False))


def truncate(x, n: int) -> Column:
    """``(x || '').slice(0, n)``; counts code points, not UTF-16 units."""
    return F.substring(F.coalesce(_c(x), F.lit("")), 1, n)


def js_string(x, numeric: bool = False) -> Column:
    """``String(x || '')``: null and '' become ''; for a numeric column 0 too.

    Only the number 0 is falsy -- the string '0' is truthy and stays '0'.
    """
    x = _c(x)
    s = x.cast("string")
    falsy = x.isNull() | (s == F.lit(""))
    if numeric:
        falsy = falsy | (x == F.lit(0)) | F.isnan(x.cast("double"))
    return F.when(falsy, F.lit("")).otherwise(s)


def clamp(x, lo: int = 0, hi: int = 100) -> Column:
    """Clamp into [lo, hi], keeping null as null (T13: greatest/least skip nulls)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def parse_int_prefix(x) -> Column:
    """``parseInt(x)``: optional sign and leading digits; null when none."""
    s = F.trim(_c(x).cast("string"))
    digits = F.regexp_extract(s, r"^([+-]?\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def js_trim(x) -> Column:
    """``String.prototype.trim``: strips JavaScript white space, not only spaces."""
    from .text import JS_SPACE

    return F.regexp_replace(_c(x), f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def utf16_length(x) -> Column:
    """``s.length`` in JavaScript: UTF-16 code units, i.e. code points plus one
    for every character outside the Basic Multilingual Plane (T10)."""
    s = _c(x)
    astral = F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(s) + astral
