"""JSON / VARIANT helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(raw) -> Column:
    """Parse a JSON string to VARIANT; malformed text gives null, not an error."""
    return F.try_parse_json(_c(raw))


def present(v: Column) -> Column:
    """True when the variant is a value other than SQL null and JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def js_truthy(v: Column) -> Column:
    """JavaScript truthiness of a VARIANT value.

    Objects and arrays (even empty ones) are truthy; null, JSON null, false,
    0 and '' are falsy; the string "0" is truthy. Objects are recognised by
    a struct-typed read (non-null for any object), so only primitives are
    serialised for the test -- no full-schema walk of large values.
    """
    is_obj = F.try_variant_get(v, "$", "struct<x:string>").isNotNull()
    is_arr = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    tj = F.to_json(v)
    falsy_primitive = tj.isin("false", '""', "null") | tj.rlike(r"^-?0+(\.0+)?([eE][+-]?\d+)?$")
    return (F.when(~present(v), F.lit(False))
             .when(is_obj, F.lit(True))
             .when(is_arr, F.lit(True))
             .otherwise(~falsy_primitive))


def unwrap(v: Column, key: str) -> Column:
    """``r[key] || r`` -- the nested value when truthy, else the record."""
    inner = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(js_truthy(inner), inner).otherwise(v)


def record_struct(fields: list[tuple[str, str]]) -> str:
    """A struct type for reading many fields of a JSON object in one pass."""
    return "struct<" + ", ".join(f"`{n}`:{t}" for n, t in fields) + ">"


def field(v: Column, name: str, dtype: str = "string") -> Column:
    """Typed field access; a value of the wrong type becomes null."""
    return F.try_variant_get(v, f"$.{name}", dtype)


def first_field(v: Column, names: list[str], dtype: str = "string") -> Column:
    """P5: ``v.a ?? v.b ?? null`` over several keys."""
    return F.coalesce(*[field(v, n, dtype) for n in names])
