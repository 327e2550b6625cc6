"""Model reply repair and typed extraction (L1, L2, X3, X4, X15; T18).

The handler's recovery chain, as one column expression per row:
strip ```json fences -> trim -> strict parse -> else parse the greedy
``{...}`` span -> else an error record carrying the raw text.

Strictness: ``JSON.parse`` rejects trailing text, Spark's variant parser does
not. The text is therefore parsed inside an array, before an end mark: text
that closes the array early keeps the mark out of it. Only a text that could
hold the mark itself is parsed a second time, inside an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import js_trim
from ..functions.text import JS_SPACE

# The error text the handler stores for an unparsable reply.
PARSE_ERROR = "JSON 파싱 실패"

END = "~~reply-end~~"

# Reply fields and their types (the response format of the prompt).
REPLY_FIELDS = [
    ("step1_category", "string"),
    ("step1_subcategory", "string"),
    ("step1_keywords", "string"),
    ("step1_id_range", "string"),
    ("diagram_id", "string"),
    ("diagram_title", "string"),
    ("category", "string"),
    ("confidence", "int"),
    ("reasoning", "string"),
    ("fault_a", "int"),
    ("fault_b", "int"),
    ("base_fault_a", "int"),
    ("base_fault_b", "int"),
    ("label_a", "string"),
    ("label_b", "string"),
    ("detected_modifiers", "array<string>"),
    ("modifier_detail", "array<struct<name:string,target:string,value:int,reason:string>>"),
    ("legal_basis", "array<string>"),
    ("precedent_refs", "array<string>"),
    ("analysis", "string"),
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_parse(text: Column) -> Column:
    """``JSON.parse``: the whole text must be exactly one JSON value."""
    arr = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    ended = F.try_variant_get(arr, "$[1]", "string") == F.lit(END)
    doubt = F.contains(text, F.lit(END)) | F.contains(text, F.lit("\\u"))  # spelt out or in escapes
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    more = F.try_variant_get(arr, "$[2]", "variant").isNotNull()
    return F.when(ended & (~doubt | (inside.isNotNull() & ~more)), F.try_variant_get(arr, "$[0]", "variant"))


def strip_fences(content) -> Column:
    """``.replace(/```json\\s*/g,'').replace(/```\\s*/g,'').trim()``."""
    c = F.coalesce(_c(content), F.lit(""))
    c = F.regexp_replace(c, f"```json[{JS_SPACE}]*", "")
    c = F.regexp_replace(c, f"```[{JS_SPACE}]*", "")
    return js_trim(c)


def repair(df: DataFrame, content: str, out: str = "reply") -> DataFrame:
    """L1: adds ``reply`` (VARIANT or null), ``parse_ok``, ``error``, ``raw``.

    Each step is a staged column (cleaned text, strict parse, fallback span),
    so the regex chain and the parse run once per row.
    """
    x = df.withColumn("_clean", strip_fences(content))
    x = x.withColumn("_first", strict_parse(F.col("_clean")))
    x = x.withColumn("_span", F.when(F.col("_first").isNull(),
                                     F.regexp_extract(F.col("_clean"), r"\{[\s\S]*\}", 0)))
    x = x.withColumn(out, F.coalesce(F.col("_first"),
                                     F.when(F.col("_span") != F.lit(""), strict_parse(F.col("_span")))))
    return (x.drop("_clean", "_first", "_span")
             .withColumn("parse_ok", F.col(out).isNotNull())
             .withColumn("error", F.when(F.col(out).isNull(), F.lit(PARSE_ERROR)))
             .withColumn("raw", F.when(F.col(out).isNull(), F.coalesce(_c(content), F.lit("")))))


def typed_fields(reply, names: list[str] | None = None,
                 fields: list[tuple[str, str]] | None = None) -> list[Column]:
    """L2: one typed column per reply field; wrong types become null.

    All fields come from ONE struct-typed read of the reply (a field of the
    wrong type is null on its own). ``names`` picks a subset.
    """
    spec = fields or REPLY_FIELDS
    if names is not None:
        spec = [(n, t) for n, t in spec if n in set(names)]
    st = "struct<" + ", ".join(f"`{n}`:{t}" for n, t in spec) + ">"
    rec = F.try_variant_get(_c(reply), "$", st)
    return [rec[name].alias(name) for name, _ in spec]
