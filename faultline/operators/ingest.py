"""Ingest shaping: flatten, defaults, validation, hashing, append.

All of it is projection over the incoming rows -- no shuffle -- so it scales
with the input and stays in whole-stage codegen (VARIANT access included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions import js
from ..functions import jsonx as jx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Video record field mapping (source key -> column, rule).
# '||' = falsy falls back to null, '??' = only null falls back.
VIDEO_FIELDS = [
    ("video_name", ["video_name"], "string", "as_is"),
    ("video_date", ["video_date"], "string", "||"),
    ("filming_way", ["filming_way"], "string", "||"),
    ("point_of_view", ["video_point_of_view"], "int", "??"),
    ("rate_a", ["accident_negligence_rateA"], "int", "??"),
    ("rate_b", ["accident_negligence_rateB"], "int", "??"),
    ("accident_object", ["accident_object"], "int", "??"),
    ("accident_place", ["accident_place"], "int", "??"),
    ("place_feature", ["accident_place_feature"], "int", "??"),
    ("vehicle_a_info", ["vehicle_a_progress_info"], "int", "??"),
    ("vehicle_b_info", ["vehicle_b_progress_info"], "int", "??"),
    ("accident_type", ["accident_type", "traffic_accident_type"], "int", "??"),
    ("damage_location", ["damage_location"], "string", "||"),
    ("related_laws", ["related_laws"], "string", "||"),
    ("violation_of_law", ["violation_of_law"], "string", "||"),
    ("additional_elements", ["additional_elements"], "string", "||"),
    ("violation_factor", ["violation_factor"], "string", "||"),
    ("weather", ["weather"], "string", "||"),
]


WHOLE_NUMBER = r"^-?[0-9]+([.]0+)?$"


def flatten_video_records(df: DataFrame, raw: str = "raw_json", wrapper: str = "video",
                          keep: list[str] | None = None) -> DataFrame:
    """One JSON record per row -> the 20 video columns + raw_json.

    The text is parsed once and all fields are read with ONE struct-typed
    variant read (a field of the wrong type becomes null on its own). Each
    step is a staged column, so Catalyst does not inline the parse into
    every consumer.

    Code and rate columns hold whole numbers. Any other value given for one
    (``33.5``, a word) is not cut or lost: the column is null and
    ``odd_values`` lists ``column=value`` as given, for a reject or a repair.
    """
    source_fields = []
    for _, keys, _, _ in VIDEO_FIELDS:
        for k in keys:
            source_fields.append((k, "string"))
    source_fields.append(("has_mp4", "boolean"))
    x = df.withColumn("_v", jx.parse(F.col(raw)))
    x = x.withColumn("_inner", F.try_variant_get(F.col("_v"), f"$.{wrapper}", "variant"))
    x = x.withColumn("_body", F.when(jx.js_truthy(F.col("_inner")), F.col("_inner")).otherwise(F.col("_v")))
    x = x.withColumn("_rec", F.try_variant_get(F.col("_body"), "$", jx.record_struct(source_fields)))
    rec = F.col("_rec")
    cols, odd = [F.col(k) for k in (keep or [])], []
    for out, keys, dtype, rule in VIDEO_FIELDS:
        val = F.coalesce(*[rec[k] for k in keys]) if len(keys) > 1 else rec[keys[0]]
        if dtype == "int":
            # nearly all are plain digits, which a cast tells; the pattern is tried on what it refuses
            given, plain = val, val.try_cast("int")
            as_given = plain.cast("string") == given
            whole = F.when(given.rlike(WHOLE_NUMBER), given.try_cast("decimal(38,6)").try_cast("int"))
            val = F.when(given.isNull() | as_given, plain).otherwise(whole)
            odd.append(F.when(given.isNotNull() & val.isNull(), F.concat(F.lit(f"{out}="), given)))
        if rule == "||":
            val = js.falsy_to_null(val, StringType() if dtype == "string" else IntegerType())
        cols.append(val.alias(out))
    cols.append(F.coalesce(rec["has_mp4"], F.lit(False)).alias("has_mp4"))
    cols.append(F.col(raw).alias("raw_json"))
    cols.append(F.nullif(F.concat_ws(";", *odd), F.lit("")).alias("odd_values"))
    return x.select(*cols)


def validate(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reject_reason") -> DataFrame:
    """Tag each row with the first failed rule (null = valid).

    ``rules`` are (name, condition-that-must-hold). Rows are never dropped:
    ``valid_rows`` / ``quarantined_rows`` split the tagged frame.
    """
    r = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        r = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(r)
    return df.withColumn(reason, r)


def valid_rows(tagged: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return tagged.where(F.col(reason).isNull()).drop(reason)


def quarantined_rows(tagged: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return tagged.where(F.col(reason).isNotNull())


def required(c) -> Column:
    """NOT NULL for strings also rejects '' (the handlers test ``!x``)."""
    c = _c(c)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def in_domain(c, values: list[str]) -> Column:
    """enumerated domain check; null passes (columns are nullable)."""
    c = _c(c)
    return c.isNull() | c.isin(*values)


# The declared value domains of the stored tables.
DOMAINS = {
    "input_type": ["text", "pdf", "ocr", "video", "mixed"],
    "category": ["차대차", "차대사람", "차대자전거"],
    "confidence": ["상", "중", "하"],
}
FEEDBACK_DOMAINS = {"expert_level": ["user", "adjuster", "lawyer", "expert"]}
PRECEDENT_DOMAINS = {"accident_type": ["차대차", "차대사람", "차대자전거"], "source": ["user", "crawl", "expert"]}
USAGE_DOMAINS = {"purpose": ["match", "analyze", "report"]}


def domain_rules(domains: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """a rule for each column with a declared domain; null passes."""
    return [(f"bad_{c}", in_domain(c, v)) for c, v in domains.items()]


def analysis_rules() -> list[tuple[str, Column]]:
    """P9/F13/F14 of an analysis row, in order: what the save handler refuses
    (no diagram, no fault of either party), then the table's NOT NULL text and
    its declared domains. An empty text or category is a default, not a value
    outside the domain."""
    rules = [("missing_diagram", required("diagram_id")), ("missing_fault_a", F.col("fault_a").isNotNull()),
             ("missing_fault_b", F.col("fault_b").isNotNull()), ("missing_input_text", F.col("input_text").isNotNull())]
    return rules + [(f"bad_{c}", in_domain(c, [*v, ""])) for c, v in DOMAINS.items()]


def length_gate(text, lo: int = 5, hi: int = 10000, units: str = "code_points") -> Column:
    """P10: 'too_short' below ``lo`` (or missing), 'too_long' above ``hi``.

    ``units='utf16'`` counts as JavaScript does (T10); the default counts code
    points, which is what SQL ``length`` returns.
    """
    n = js.utf16_length(_c(text)) if units == "utf16" else F.length(_c(text))
    return (F.when(_c(text).isNull() | (n < F.lit(lo)), F.lit("too_short"))
             .when(n > F.lit(hi), F.lit("too_long")).otherwise(F.lit("ok")))


def salted_hash(c, salt: str, n: int = 16) -> Column:
    """First ``n`` hex chars of SHA-256(value || salt); null value hashes ''.

    The salt is a required argument: no built-in fallback secret.
    """
    if not salt:
        raise ValueError("salt is required")
    return F.substring(F.sha2(F.concat(F.coalesce(_c(c).cast("string"), F.lit("")), F.lit(salt)), 256), 1, n)


# Analysis record defaults and truncation lengths.
ANALYSIS_TEXT_LIMITS = {"input_text": 10000, "pdf_text": 20000, "ocr_text": 5000,
                        "analysis_text": 5000, "user_agent": 500}
ANALYSIS_DEFAULTS = {"input_type": "text", "confidence": "하", "label_a": "A", "label_b": "B"}


# List-valued columns and their element types; absent means [].
ANALYSIS_LISTS = {
    "alt_diagrams": "array<struct<id:string,t:string,score:int>>",
    "detected_mods": "array<string>",
    "applied_mods": "array<struct<n:string,v:int,tg:string,applied:boolean>>",
    "laws": "array<struct<a:string,d:string>>",
}


def shape_analysis_records(df: DataFrame, salt: str | None = None, ip: str = "ip") -> DataFrame:
    """Defaults, boolean coercion, truncation and the IP hash.

    Expects the request columns by name; absent optional ones are null, and
    absent lists become []. With ``salt`` the row gets ``ip_hash`` from the
    ``ip`` column ('' when there is none), as the save handler does.
    """
    def col(name, dtype="string"):
        return F.col(name) if name in df.columns else F.lit(None).cast(dtype)

    out = {}
    for name, n in ANALYSIS_TEXT_LIMITS.items():
        out[name] = js.truncate(col(name), n)
    for name, d in ANALYSIS_DEFAULTS.items():
        out[name] = js.falsy_default(col(name), d)
    for name in ("has_pdf", "has_image", "has_video", "llm_used"):
        out[name] = js.truthy(col(name, "boolean"))
    for name in ("diagram_title", "category", "subcategory"):
        out[name] = js.falsy_default(col(name), "")
    for name, dtype in ANALYSIS_LISTS.items():
        out[name] = F.coalesce(col(name, dtype), F.array().cast(dtype))
    out["match_score"] = js.falsy_default(col("match_score", "int"), F.lit(0), IntegerType())
    out["session_id"] = js.falsy_to_null(col("session_id"))
    out["diagram_id"] = col("diagram_id")
    for name in ("fault_a", "fault_b", "base_fault_a", "base_fault_b"):
        out[name] = col(name, "int")
    if salt is not None:
        out["ip_hash"] = salted_hash(col(ip), salt)
    passthrough = [c for c in df.columns if c not in out and c != ip]
    return df.select(*passthrough, *[v.alias(k) for k, v in out.items()])


def with_generated_ids(df: DataFrame, id_col: str = "id", ts_col: str = "created_at") -> DataFrame:
    """Assign ``uuid()`` and ``now()`` once, before the write.

    ``uuid()`` is non-deterministic: persist the result (write it) and read
    the written rows back instead of recomputing this frame.
    """
    return df.withColumn(id_col, F.expr("uuid()")).withColumn(ts_col, F.current_timestamp())


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """K1-K4: append rows to a table directory."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def shape_llm_records(df: DataFrame) -> DataFrame:
    """The model-result row written next to an analysis.

    ``llm_diagram_id || null``, faults ``?? null`` (0 kept), confidence
    ``|| null`` (0 dropped), texts cut to 5,000 code points, modifiers
    default to [], tokens ``|| 0``, and the engine-agreement flag.
    """
    def col(name, dtype="string"):
        return F.col(name) if name in df.columns else F.lit(None).cast(dtype)

    a, b = js.js_string(col("llm_diagram_id")), js.js_string(col("engine_diagram_id"))
    out = {
        "llm_diagram_id": js.falsy_to_null(col("llm_diagram_id")),
        "llm_fault_a": col("llm_fault_a", "int"),
        "llm_fault_b": col("llm_fault_b", "int"),
        "llm_confidence": js.falsy_to_null(col("llm_confidence", "int"), IntegerType()),
        "llm_reasoning": js.truncate(col("llm_reasoning"), 5000),
        "llm_analysis": js.truncate(col("llm_analysis"), 5000),
        "llm_modifiers": F.coalesce(col("llm_modifiers", "array<string>"), F.array().cast("array<string>")),
        "llm_tokens": js.falsy_default(col("llm_tokens", "int"), F.lit(0), IntegerType()),
        "matches_engine": a == b,
    }
    drop = set(out) | {"engine_diagram_id"}
    passthrough = [c for c in df.columns if c not in drop]
    return df.select(*passthrough, *[v.alias(k) for k, v in out.items()])


def table_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """SQL column DEFAULTs -- they fill columns the insert omits.

    An explicit NULL in a present column stays NULL, as in the database.
    """
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return df


# Declared column defaults of the feedback and precedent tables.
FEEDBACK_DEFAULTS = {"expert_level": "user"}
PRECEDENT_DEFAULTS = {"confidence": 50, "verified": False, "source": "user"}


def append_returning(df: DataFrame, path: str, returning: tuple[str, ...] = ("id", "created_at"),
                     id_col: str = "id", ts_col: str = "created_at") -> DataFrame:
    """K1: append rows with generated ids and return the generated columns.

    Ids and timestamps are assigned once, the batch is written to its own
    ``write_id=<uuid>`` folder under the table (so the table stays one
    partitioned dataset), and the returned frame READS that folder back --
    ``uuid()`` is never evaluated twice for the same row.
    """
    import uuid

    write_id = uuid.uuid4().hex
    target = f"{path.rstrip('/')}/write_id={write_id}"
    with_generated_ids(df, id_col, ts_col).write.mode("error").parquet(target)
    return df.sparkSession.read.parquet(target).select(*returning)
