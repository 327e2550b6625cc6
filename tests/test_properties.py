"""Invariants, checked on generated batches of cases.

Each Hypothesis example is a whole list of cases evaluated in one Spark
job, so few jobs cover many inputs.
"""

import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import js
from faultline.operators import accuracy as acc
from faultline.operators import upsert as ups

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

counts = st.integers(min_value=1, max_value=10**12).flatmap(
    lambda n: st.tuples(st.integers(min_value=0, max_value=n), st.just(n)))


@SETTINGS
@given(st.lists(counts, min_size=1, max_size=60))
def test_decimal_percent_is_exact_half_up(spark, cases):
    df = spark.createDataFrame(cases, "c long, n long")
    got = [r["p"] for r in df.select(js.decimal_percent("c", "n").alias("p")).collect()]
    want = [(Decimal(c) * 100 / Decimal(n)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            if c * 100 < 1000 * n else None for c, n in cases]
    # precision 5,2 holds up to 999.99; percentages of c <= n are at most 100
    assert got == want


@SETTINGS
@given(st.lists(counts, min_size=1, max_size=60))
def test_js_percent_matches_double_arithmetic(spark, cases):
    df = spark.createDataFrame(cases, "c long, n long")
    got = [r["p"] for r in df.select(js.percent_half_up("c", "n").alias("p")).collect()]
    want = [math.floor(c / n * 100 * 100 + 0.5) / 100 for c, n in cases]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-500, 500)), st.integers(-500, 500)),
                min_size=1, max_size=60))
def test_clamp_stays_in_range(spark, cases):
    df = spark.createDataFrame(cases, "b int, m int")
    out = [r["x"] for r in df.select(js.clamp(F.col("b") + F.col("m")).alias("x")).collect()]
    for (b, m), x in zip(cases, out):
        assert (x is None) if b is None else (x == max(0, min(100, b + m)))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["101", "보4", "거2", ""]), st.one_of(st.none(), st.booleans())),
                min_size=1, max_size=80))
def test_stats_counts_are_consistent(spark, cases):
    df = spark.createDataFrame(cases, "d string, is_correct boolean")
    for r in acc.diagram_stats(df, "d").collect():
        assert r["correct_count"] + r["incorrect_count"] <= r["total_matches"]
        assert Decimal(0) <= r["accuracy_pct"] <= Decimal(100)


keys = st.one_of(st.none(), st.integers(0, 30))


@SETTINGS
@given(st.lists(st.integers(0, 30), unique=True, max_size=30), st.integers(0, 3), st.lists(keys, max_size=40))
def test_upsert_row_count_is_key_union(spark, unique_keys, target_nulls, source_keys):
    # the target has a primary key: unique non-null keys (plus rows whose key is null)
    target_keys = unique_keys + [None] * target_nulls
    t = spark.createDataFrame([(k, "t") for k in target_keys], "k int, v string")
    s = spark.createDataFrame([(k, "s", i) for i, k in enumerate(source_keys)], "k int, v string, o int")
    out = ups.upsert(t, s, "k", on_duplicate="last", order=["o"])
    tk = {k for k in target_keys if k is not None}
    sk = {k for k in source_keys if k is not None}
    nulls = sum(k is None for k in target_keys) + sum(k is None for k in source_keys)
    assert out.count() == len(tk | sk) + nulls
    assert {r["k"] for r in out.where(F.col("v") == "s").collect() if r["k"] is not None} == sk
