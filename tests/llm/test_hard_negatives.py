"""Hard negatives against a comparison of every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from faultline.llm import hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, label int, vec array<long>, rank int"


def mined(rows, anchors, low=80, high=100):
    """[(anchor, positive, rank, negative, scores)] of (id, label, vector) rows; shorter vectors are filled with zeros."""
    dim = max((len(r[2]) for r in rows), default=0)
    rows = [(i, k, np.array([*v, *[0] * (dim - len(v))], np.int64)) for i, k, v in rows]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        by = sorted((-int(v @ w), j, k, b) for b, (j, k, w) in enumerate(rows) if b != at)
        for s, j, *_ in [x for x in by if x[2] == label][:5]:
            hard = [x for x in by if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:5]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(hard)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_multi_sequence_visits_all_sums_from_the_highest_down():
    u, v = np.array([3.0, 9.0, 1.0]), np.array([2.0, 2.0, 7.0, 0.0])
    got = list(hard_negatives.multi_sequence(u, v))
    assert [s for s, _, _ in got] == sorted((x + y for x in u for y in v), reverse=True)
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(3) for j in range(4)}


def clustered(n, seed=1, kinds=12):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(0, 100, (kinds, 8))
    own = rnd.integers(0, kinds, n)
    vecs = np.floor(centre[own] + rnd.normal(0, 8, (n, 8))).astype(int)
    return [(i, int(own[i] * 7 % 4), [int(x) for x in vecs[i]]) for i in range(n)]


def test_clustered_rows_are_certified_before_all_cells_are_seen(spark, monkeypatch):
    rows = clustered(3000)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 300)
    monkeypatch.setattr(hard_negatives, "MORE", 3)
    seen, plan = [], hard_negatives._plan
    monkeypatch.setattr(hard_negatives, "_plan", lambda index, n: (seen.append(n), plan(index, n))[1])
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = collected(hard_negatives.mine(df, F.col("id") % 100 == 0, rows_per_cell=30))
    assert got == mined(rows, lambda i: i % 100 == 0) and got
    # a search goes through all rows only in its fifth round (300 + 900 + 2700 …)
    assert seen.count(300) == 2 and max(seen) <= 2700


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, i % 2, [3, 4]) for i in range(0, 400, 5)]  # one vector, two labels, many ids
    rows += [(1001, 0, [3, 4, 1]), (1002, 1, []), (1003, 1, [0, 0]), (1100, 0, [-3, -4]), (1101, 1, [-3, -4]), (1200, 5, [1, 1]), (1300, 0, [1 << 20, 7]), (1301, 1, [1 << 20, 5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert collected(hard_negatives.mine(df, F.col("id") % 100 == 0)) == mined(rows, lambda i: i % 100 == 0)
    assert collected(hard_negatives.mine(df, F.col("id") < 300, low=50, high=90)) == mined(rows, lambda i: i < 300, 50, 90)


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, 0, [1, 2], None)], SCHEMA), F.col("id") % 100 == 0).collect() == []


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    got = collected(E.queries()["op12_hard_negatives"](spark, sf))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    rows = [(i, k, v) for i, k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v]) for i, k, v in rows]
    assert got == mined(rows, lambda i: i % 100 == 0)


def test_query_leaves_out_rows_that_are_not_finite(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [1.0, 0.3]), (3, 2, None), (4, None, [1.0, 0.3]), (5, 2, [1.0, None]), (6, 2, [1.0, float("nan")]),
            (8, 2, [1.0, float("inf")]), (7, 0, [1.0, 0.35]), (9, 2, [1.0, float("-inf")])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collected(E.queries()["op12_hard_negatives"](spark, str(tmp_path)))
    assert got == [(0, 1, 1, 2, 65536 + 102 * 128, 65536 + 76 * 128)] or {r[3] for r in got} <= {2}
    assert {(r[0], r[1]) for r in got} <= {(0, 1), (0, 7)}
