"""Rules from tables and searches from a table of requests, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import text as tx
from faultline.operators import rule_tables as tbl
from faultline.operators import rules as rul
from faultline.operators import search as srch

RULES = "label string, level int, keyword string, position int, scope string"


def test_grams_of_texts_and_patterns(spark):
    rows = spark.createDataFrame([("ABCD",), ("a_bc%de",), ("a%b",), ("%_",), ("",), (None,), ("é日本語",)], "t string")
    got = [(r.g, r.p) for r in rows.select(tx.text_grams("t").alias("g"), tx.pattern_grams("t").alias("p")).collect()]
    assert sorted(got[0][0]) == ["a", "ab", "abc", "b", "bc", "bcd", "c", "cd", "d"] and got[0][1] == ["abc", "bcd"]
    assert [p for _, p in got[1:5]] == [["bc", "de"], ["a", "b"], [], []]  # the longest kind there is
    assert got[5] == ([], None) and got[6][1] == ["é日本", "日本語"]


def test_odd_escapes_are_the_character_itself(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",), ("a%b",)], "t string")
    for kw in ("a\\b", "a\\%b", "a\\\\b"):
        one = [r.t for r in df.where(tx.ilike_contains("t", kw)).collect()]
        each = [r.t for r in df.where(tx.ilike_contains("t", F.lit(kw))).collect()]
        assert one == each == {"a\\b": ["ab"], "a\\%b": ["a%b"], "a\\\\b": ["a\\b"]}[kw]


CASES = "id long, keywords_text string, categories string, court string, fault_a int, relevance_score double, fault_ratio string"


def _cases(n, seed=1):
    r = random.Random(seed)
    words = ["교차로", "신호", "Blue", "ring", "gear", "ab", "x%y", "under_score", "고속도로 본선"]
    return [(i if i % 50 else None, " ".join(r.choices(words, k=3)) if i % 17 else None, r.choice(["PROMO", "small", "", None]), f"Court {i % 7}",
             r.choice([None, *range(0, 100, 10)]), r.choice([None, 1.0, 2.0, 3.0]), None if i % 23 == 0 else "1:1") for i in range(n)]


@pytest.mark.parametrize("literal", [False, True])
def test_a_table_of_requests_equals_one_search_each(spark, literal):
    cases = spark.createDataFrame(_cases(400), CASES)
    r = random.Random(2)
    reqs = [(k, r.choice(["blue", "신호 gear", "b_ue", "%%", "a, b", "nothing", "Ri", "x%y", "", None, "under_score 교차"]), r.choice([None, "", "pro", "%"]), r.choice([None, "court 3", "t"]),
             r.choice([None, "", "0", "20", "x"]), r.choice([None, "50", "90 percent"]), r.choice([None, "3", "0", "99", "-4", "7.9"])) for k in range(120)]
    names = ["keywords", "categories", "court", "fault_min", "fault_max", "limit"]
    table = spark.createDataFrame(reqs, "request_id long, " + ", ".join(f"{n} string" for n in names))
    got = {}
    for x in srch.search_table(cases, table, literal=literal).collect():
        got.setdefault(x["request_id"], []).append((x["rank"], x["relevance_score"], x["id"]))
    for k, *values in reqs:
        req = srch.SearchRequest(**dict(zip(names, values, strict=True)), literal=literal)
        one = [(x["relevance_score"], x["id"]) for x in srch.search(cases, req).collect()]
        assert [x[1:] for x in sorted(got.get(k, []), key=lambda x: x[0])] == one, values


def test_numeric_bounds_and_limits_of_requests(spark):
    cases = spark.createDataFrame(_cases(100), CASES)
    table = spark.createDataFrame([(1, 0, 30, 5), (2, 40, 0, None), (3, None, None, 0)], "request_id long, fault_min int, fault_max int, limit int")
    got = srch.search_table(cases, table).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("fault_a").alias("hi"), F.min("fault_a").alias("lo")).collect()
    assert {(r.request_id, r.n) for r in got} == {(1, 5), (2, 10), (3, 10)}
    assert all(r.hi <= 30 for r in got if r.request_id == 1) and all(r.lo >= 40 for r in got if r.request_id == 2)


def test_the_plan_does_not_grow_with_the_requests(spark):
    cases = spark.createDataFrame(_cases(50), CASES)
    sizes = []
    for n in (10, 10_000):
        reqs = spark.range(n).select(F.col("id").alias("request_id"), F.concat(F.lit("신호 "), F.col("id").cast("string")).alias("keywords"))
        plan = srch.search_table(cases, reqs)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1]
    assert srch.search_table(cases, reqs).select("request_id").distinct().count() == 10_000


def test_sets_of_words_are_not_met_row_by_row(spark, monkeypatch):
    """2,000 copies of each of 8 texts, and 2,000 requests whose two words all of them hold: the tables between are far smaller than texts times requests."""
    kept = []
    write = srch._kept
    monkeypatch.setattr(srch, "_kept", lambda df: kept.append(write(df)) or kept[-1])
    cases = [(i, f"all same w{i % 8}", "kind", "court", i % 3, float(i // 3 % 5), "1:1") for i in range(16_000)] + [(5, "all same w5", "kind", "court", 2, 1.0, "1:1")] * 2
    reqs = spark.range(2000).selectExpr("id AS request_id", "concat('all same w', id) AS keywords", "id % 2 AS fault_min", "3 AS limit")
    out = srch.search_table(spark.createDataFrame(cases, CASES), reqs).select("request_id", "rank", "relevance_score", "id", "fault_a").collect()
    assert len(out) == 6000 and len({(x.request_id, x.rank) for x in out}) == 6000
    for k in range(2):
        want = [(c[5], c[0]) for c in sorted((c for c in cases if c[4] >= k or k == 0), key=lambda c: (-c[5], c[0]))[:3]]
        assert all([(x.relevance_score, x.id) for x in sorted((y for y in out if y.request_id == n), key=lambda x: x.rank)] == want for n in (k, k + 1000))
    assert sorted(x.count() for x in kept)[-2] < 20_000 and len(kept) >= 4  # the requests' words and the cases themselves are the largest


def test_keyword_hits_equal_a_loop(spark):
    r = random.Random(3)
    letters = "ab신호c"
    kws = ["".join(r.choices(letters, k=r.choice([1, 2, 2, 3, 4, 6]))) for _ in range(300)]
    rules = [(f"L{i % 9}", i % 4, w, i, "s" if i % 5 == 0 else None) for i, w in enumerate(kws)] + [("none", 0, "", 900, None), ("null", 0, None, 901, None)]
    texts = [(i, "".join(r.choices(letters + " ", k=r.choice([0, 1, 2, 5, 40])))) for i in range(80)] + [(80, None), (81, "Ab" * 20_000)]
    df = spark.createDataFrame(texts, "i int, t string")
    for ignore in (False, True):
        hit = tbl.with_keyword_hits(df, "i", "t", spark.createDataFrame(rules, RULES), ignore_case=ignore)
        got = {x.i: ([(h.level, h.neg_len, h.position, h.label, h.keyword) for h in x.hits], x.w) for x in hit.select("i", "hits", tbl.winner("hits")["label"].alias("w")).collect()}
        assert len(got) == len(texts)
        for i, t in texts:
            t = (t or "").lower() if ignore else t or ""
            want = sorted((lv, -len(w), p, lb, w, s) for lb, lv, w, p, s in rules if w and (w.lower() if ignore else w) in t)
            assert [x[:3] for x in got[i][0]] == [x[:3] for x in want], i
            assert got[i][1] == next((x[3] for x in want if x[5] is None), None)


def test_keyword_hits_move_no_text_that_is_dealt_by_its_key(spark):
    rules = spark.createDataFrame([(f"L{i}", 1, f"STANDARD KIND {i}", i, None) for i in range(200)] + [("short", 2, "KI", 900, None)], RULES)
    df = spark.createDataFrame([(i, f"a STANDARD KIND {i}; ") for i in range(50)] * 2 + [(None, "STANDARD KIND 7"), (None, "KI"), (None, None)], "i int, t string")
    texts = df.groupBy("i").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("t"))
    hit = tbl.with_keyword_hits(texts, "i", "t", rules)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(coalesce(i#" not in plan and plan.count("hashpartitioning(_key#") == 1  # of the rows without a key
    got = {x.i: [h.position for h in x.hits] for x in hit.collect()}
    for i in range(50):
        assert got[i] == sorted(range(200), key=lambda k: (-len(str(k)), k) if str(i).startswith(str(k)) else (9, 9))[:sum(str(i).startswith(str(k)) for k in range(200))] + [900]
    each = sorted([h.position for h in x.hits] for x in tbl.with_keyword_hits(df.where("i IS NULL"), "i", "t", rules).collect())
    assert each == [[], [7, 900], [900]]


@pytest.mark.parametrize("few", [0, 1000])
def test_keyword_hits_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(tbl, "BROADCAST_RULES", few)
    rules = [("a", 1, "long keyword one", 0, None), ("b", 1, "keyword", 1, "s"), ("c", 0, "k", 2, None), ("c", 0, "k", 2, None), ("d", 0, None, 3, None)]
    df = spark.createDataFrame([(1, "a long keyword one"), (1, "k"), (2, "keyword keyword"), (3, None), (None, "one k")], "i int, t string")
    got = sorted([h.label for h in x.hits] for x in tbl.with_keyword_hits(df, "i", "t", spark.createDataFrame(rules, RULES)).collect())
    assert got == sorted([["c", "a", "b"], ["c"], ["c", "b"], [], ["c"]])


def test_rule_table_equals_the_literal_rules(spark):
    from faultline.plans.text import ACCIDENTS, rule_rows

    df = spark.createDataFrame(list(enumerate([*ACCIDENTS, "", "무신호 신호"])), "i int, t string")
    lit = rul.subclassify(rul.classify(df, "t"), "t", "category").orderBy("i").collect()
    hit = tbl.with_keyword_hits(df, "i", "t", rule_rows(spark))
    out = hit.withColumn("category", F.coalesce(tbl.winner("hits")["label"], F.lit(rul.CATEGORY_DEFAULT)))
    out = out.select("i", "category", tbl.winner("hits", "category")["label"].alias("sub"), tbl.winner("hits")["keyword"].alias("kw")).orderBy("i").collect()
    defaults = {c: d for c, (_, d) in rul.SUBCATEGORY_RULES.items()}
    assert [(a.category, a.matched_keyword, a.subcategory) for a in lit] == [(b.category, b.kw, b.sub or defaults[b.category]) for b in out]


def test_matching_ranges_equal_all_pairs(spark):
    r = random.Random(4)
    ranges = [(i, r.choice("ab"), lo, lo + r.choice([-1, 0, 1, 5, 7, 8, 100, 4096, 10**9])) for i, lo in enumerate(r.randrange(-500, 2000) for _ in range(400))]
    ranges += [(900, "a", None, 5), (901, "b", 5, None), (902, None, 1, 3), (903, "a", -(10**15), 10**15)]
    points = [(r.choice(["a", "b", "c"]), r.randrange(-600, 3000)) for _ in range(300)] + [("a", None), (None, 2), ("a", 10**9)]
    p = spark.createDataFrame(points, "k string, n long").distinct()
    met = tbl.matching_ranges(p, spark.createDataFrame(ranges, "rule int, k string, lo long, hi long"), ["k"], "n")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(k, n, i) for k, n in set(points) for i, c, lo, hi in ranges if None not in (k, n, lo, hi) and c == k and lo <= n <= hi}
    got = [(x.k, x.n, x.rule) for x in met.collect()]
    assert set(got) == want and len(got) == len(want)


def test_range_check_table_equals_the_literal_check(spark):
    ids = [("차대차", "101"), ("차대차", "127"), ("차대사람", "보4"), ("차대사람", "보99"), ("차대사람", "4"), ("차대자전거", "거2"), ("x", "101"), (None, "1"), ("차대차", "abc"), ("차대차", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(ids)], "i int, cat string, id string")
    pre, num = rul.split_diagram_id("id")
    ok, why = rul.range_check(F.col("cat"), pre, num, rul.category_ranges())
    want = [tuple(r) for r in df.select("i", ok.alias("in_range"), why.alias("reason")).orderBy("i").collect()]
    ranges = spark.createDataFrame(rul.category_ranges(), "category string, prefix string, lo int, hi int")
    got = [tuple(r) for r in tbl.range_check_table(df, "cat", pre, num, ranges).select("i", "in_range", "reason").orderBy("i").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got if ids[g[0]][0]] == [w[2] for w in want if ids[w[0]][0]]


def test_a_hundred_thousand_ranges(spark):
    ranges = spark.range(100_000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 7 % 1_000_003).alias("lo"), (F.col("id") * 7 % 1_000_003 + F.col("id") % 40).alias("hi"))
    points = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 53 % 1_000_003).alias("n"))
    met = tbl.matching_ranges(points, ranges, ["k"], "n").groupBy().agg(F.count(F.lit(1)), F.sum("lo")).first()
    by = {}
    for i in range(100_000):
        lo = i * 7 % 1_000_003
        for n in range(lo, lo + i % 40 + 1):
            by.setdefault((str(i % 3), n), []).append(lo)
    want = [lo for i in range(20_000) for lo in by.get((str(i % 3), i * 53 % 1_000_003), [])]
    assert tuple(met) == (len(want), sum(want))
