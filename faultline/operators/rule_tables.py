"""Rules that come from tables (J7, J8, L3, L4; T21, T22).

Keyword rules: the distinct grams of a text are joined to one gram of
each keyword, the one that fewest keywords share; only keywords met that way are
looked for in the text. The cost follows the texts and the hits, not the
number of keywords. Ranges: a range lies in one or two bins of its own power of two,
a number in one bin of each size in use, so containment is an equi-join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import grams
from ..session import scratch_path

ANCHOR = 8  # characters of a keyword by which it is looked up; a shorter one is looked up whole
BROADCAST_RULES = 100_000  # up to so many rules are broadcast to the texts


def _anchors(rules: DataFrame, name: str) -> DataFrame:
    """``gram, name`` of each row of ``keyword, name``: the gram of its keyword, ``ANCHOR`` characters or the whole of a shorter one, that fewest rules share."""
    word = F.col("keyword")
    each = rules.select(name, F.explode(F.array_distinct(F.when(F.length(word) > ANCHOR, grams(word, ANCHOR)).otherwise(F.array(word)))).alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(often, "gram").groupBy(name).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def with_keyword_hits(df: DataFrame, key: str, text: str, rules: DataFrame, out: str = "hits", ignore_case: bool = False) -> DataFrame:
    """``df`` with the rules whose keyword its text contains, as an array in the order in which they win.

    ``rules``: ``label, level, keyword, position`` and ``scope`` (may be null), any
    number of them. The array holds (level, neg_len, position, label, keyword, scope):
    the lowest level first, then the longest keyword, then the table's order.
    ``key`` tells the texts apart; rows may share one. Null and empty keywords
    match nothing, a null text holds none.

    Up to ``BROADCAST_RULES`` rules go to the texts: a keyword is looked for where its gram
    is met, and only the numbers of the rules that a text holds are put together by key, which
    moves nothing of a ``df`` that is dealt by its key. More rules are joined by shuffled grams.
    """
    kw = F.lower("keyword") if ignore_case else F.col("keyword")
    scope = F.col("scope") if "scope" in rules.columns else F.lit(None).cast("string")
    r = rules.select("level", (-F.length("keyword")).alias("neg_len"), "position", "label", kw.alias("keyword"), scope.alias("scope"))
    r = r.where(F.length("keyword") > 0).select(F.struct(*r.columns).alias("rule")).distinct()
    t = F.lower(text) if ignore_case else F.col(text)
    sizes = r.select(F.least(F.length("rule.keyword"), F.lit(ANCHOR)).alias("size")).groupBy("size").count().collect()  # ANCHOR rows at most
    if not sizes:
        return df.withColumn(out, F.array().cast(T.ArrayType(r.schema["rule"].dataType)))
    pairs = F.array_distinct(F.concat(*[grams(t, x["size"]) for x in sorted(sizes)]))
    if sum(x["count"] for x in sizes) > BROADCAST_RULES:
        anchors = _anchors(r.select("rule.keyword", "rule"), "rule")
        met = df.select(F.col(key).alias("_key"), F.explode(pairs).alias("gram")).join(anchors, "gram")
        met = met.groupBy("_key").agg(F.collect_set("rule").alias("_met"))  # the rules that one text meets
        held = F.filter("_met", lambda x: F.contains(t, x["keyword"]))
        none = F.array().cast(met.schema["_met"].dataType)
        return df.join(met, df[key].eqNullSafe(met["_key"]), "left").withColumn(out, F.coalesce(F.array_sort(held), none)).drop("_key", "_met")

    path = scratch_path(df.sparkSession, "rules", uuid.uuid4().hex)
    r.agg(F.array_sort(F.collect_list("rule")).alias("_rules")).write.parquet(path)  # once, for a number to mean one rule
    table = df.sparkSession.read.parquet(path)
    numbers = table.select(F.posexplode("_rules").alias("number", "rule")).select("number", "rule.keyword")
    anchors = F.broadcast(_anchors(numbers, "number").join(numbers, "number").select("gram", "number", "keyword"))

    def held_by(rows: DataFrame, by: Column) -> DataFrame:
        met = rows.select(by.alias("_key"), t.alias("_text"), F.explode(pairs).alias("gram")).join(anchors, "gram").where(F.contains("_text", "keyword"))
        met = met.groupBy("_key").agg(F.array_sort(F.collect_set("number")).alias("_met"))
        return rows.join(met, by == met["_key"], "left").crossJoin(F.broadcast(table))

    # a plain comparison keeps the rows where they are; those without a key go by their text
    both = held_by(df.where(F.col(key).isNotNull()), df[key]).unionByName(held_by(df.where(F.col(key).isNull()), t))
    held = F.filter(F.coalesce("_met", F.array().cast("array<int>")), lambda i: F.contains(t, F.get("_rules", i)["keyword"]))
    return both.withColumn(out, F.transform(held, lambda i: F.get("_rules", i))).drop("_key", "_met", "_rules")


def winner(hits, scope=None) -> Column:
    """L3/L4: the first of the hits whose scope is the given one (null: the rules without a scope), or null."""
    h = F.col(hits) if isinstance(hits, str) else hits
    c = F.lit(None).cast("string") if scope is None else F.col(scope) if isinstance(scope, str) else scope
    return F.get(F.filter(h, lambda x: x["scope"].eqNullSafe(c)), F.lit(0))


def matching_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], number: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each row of ``points`` with every range of the same ``keys`` that holds ``number``, both ends included.

    Any number of ranges, of any widths; overlapping ranges all match. Nulls and
    ranges that end before they begin match nothing. The sizes of bins in use (63 at
    most) are read from the table first.
    """
    r = ranges.where(F.col(lo) <= F.col(hi)).withColumns({lo: F.col(lo).cast("long"), hi: F.col(hi).cast("long")})
    span = F.col(hi) - F.col(lo)
    r = r.withColumn("_size", F.when(span == 0, 0).otherwise(F.length(F.bin(span))))
    bins = F.array_distinct(F.array(F.expr(f"shiftright({lo}, _size)"), F.expr(f"shiftright({hi}, _size)")))
    r = r.withColumn("_bin", F.explode(bins))
    sizes = sorted(x["_size"] for x in r.select("_size").distinct().collect())
    p = points.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")))
    p = p.withColumn("_bin", F.expr(f"shiftright(CAST({number} AS BIGINT), _size)"))
    both = p.join(r, [*keys, "_size", "_bin"])
    return both.where(F.col(number).between(F.col(lo), F.col(hi))).drop("_size", "_bin")


def range_check_table(df: DataFrame, category: str, prefix: Column, number: Column, ranges: DataFrame,
                      ok: str = "in_range", reason: str = "reason") -> DataFrame:
    """``rules.range_check`` with the ranges in a table (``category, prefix, lo, hi``).

    Each distinct (category, prefix, number) is looked up once, so a number that
    a third of the rows hold is no hot key.
    """
    rows = df.withColumns({"_pre": F.coalesce(prefix, F.lit("")), "_num": number.cast("long")})
    rules = ranges.select(F.col("category").alias("_cat"), F.col("prefix").alias("_pre"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    asked = rows.select(F.col(category).alias("_cat"), "_pre", "_num").where("_num IS NOT NULL").distinct()
    inside = matching_ranges(asked, rules, ["_cat", "_pre"], "_num", "_lo", "_hi").select("_cat", "_pre", "_num").distinct().withColumn("_in", F.lit(True))
    known = rules.select(F.col("_cat").alias("_known")).distinct()
    out = rows.withColumn("_cat", F.col(category)).join(inside, ["_cat", "_pre", "_num"], "left").join(known, F.col("_cat") == F.col("_known"), "left")
    why = (F.when(F.col("_known").isNull(), "no_rule").when(F.col("_num").isNull(), "bad_id").when(F.col("_in").isNull(), "out_of_range"))
    return out.withColumns({ok: F.coalesce("_in", F.lit(False)), reason: why}).select(*df.columns, ok, reason)
