"""Hand-made rows, one check per semantic trap and fixture."""

from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from faultline.functions import js
from faultline.functions.text import ilike_contains, search_words
from faultline.operators import accuracy as acc
from faultline.operators import ingest as ing
from faultline.operators import render as rnd
from faultline.operators import replies as rpl
from faultline.operators import reports as rep
from faultline.operators import rules as rul
from faultline.operators import search as srch
from faultline.operators import sessions as ses
from faultline.operators import upsert as ups
from faultline.operators import usage as use


def one(df, col):
    return [r[col] for r in df.collect()]


# ------------------------------------------------------------- T5, T6, T9

def test_tolerance_verdict_t9(spark):
    df = spark.createDataFrame([(50, 60), (50, 61), (50, None), (None, 40)], "p int, a int")
    out = one(df.select(acc.tolerance_verdict("p", "a").alias("v")), "v")
    assert out == [True, False, None, False]


def test_two_accuracies_t5(spark):
    rows = [("101", True), ("101", False), ("101", None), ("보4", True)]
    df = spark.createDataFrame(rows, "d string, is_correct boolean")
    app = {r["d"]: r for r in acc.accuracy_by_key(df, "d").collect()}
    assert app["101"]["total_count"] == 2 and app["101"]["accuracy_rate"] == 50.0
    assert app["보4"]["accuracy_rate"] == 100.0
    trig = {r["diagram_id"]: r for r in acc.diagram_stats(df, "d").collect()}
    assert trig["101"]["total_matches"] == 3
    assert trig["101"]["accuracy_pct"] == Decimal("33.33")
    assert trig["보4"]["accuracy_pct"] == Decimal("100.00")


def test_rounding_t6(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (1, 200)], "c long, n long")
    out = df.select(js.percent_half_up("c", "n").alias("app"), js.decimal_percent("c", "n").alias("db")).collect()
    assert [r["app"] for r in out] == [33.33, 66.67, 12.5, 0.5]
    assert [r["db"] for r in out] == [Decimal("33.33"), Decimal("66.67"), Decimal("12.50"), Decimal("0.50")]
    # Math.round on doubles: 1.005 * 100 = 100.49999999999999 -> 100
    d = spark.createDataFrame([(1.005,)], "x double")
    assert d.select(js.half_up_round("x", 2).alias("r")).first()["r"] == 1.0


def test_running_accuracy_chunks_match_brute_force(spark):
    import random

    random.seed(7)
    rows = [(i, "hot" if i % 3 else "cold", i * 10, random.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, t long, ok boolean")
    out = acc.running_accuracy(df, ["g"], ["t", "id"], "ok", (F.col("t") / 250).cast("long"))
    got = {r["id"]: (r["n_seen"], r["n_ok"]) for r in out.collect()}
    seen, ok = {}, {}
    for i, g, t, k in rows:
        seen[g] = seen.get(g, 0) + 1
        ok[g] = ok.get(g, 0) + int(k)
        assert got[i] == (seen[g], ok[g])


def test_accuracy_merge_equals_recompute(spark):
    rows = [("a", True), ("a", False), ("b", True), ("c", None)]
    df = spark.createDataFrame(rows, "d string, is_correct boolean")
    state = acc.accuracy_by_key(df.where(F.col("d") == "a"), "d")
    delta = acc.accuracy_by_key(df.where(F.col("d") != "a"), "d")
    merged = sorted(tuple(r) for r in acc.accuracy_merge(state, delta, "d").collect())
    full = sorted(tuple(r) for r in acc.accuracy_by_key(df, "d").collect())
    assert merged == full


# ------------------------------------------------------------- T1, T2, T3, T4, T7

def test_place_type_means_t3(spark):
    rows = [("p", "t", 10, None), ("p", "t", 20, 80), ("p", "t", None, 50)]
    df = spark.createDataFrame(rows, "place string, type string, a int, b int")
    r = rep.group_rounded_means(df, ["place", "type"], {"avg_a": "a", "avg_b": "b"}, null_filter="a",
                                legacy_key="k").first()
    assert r["count"] == 2 and r["avg_a"] == 15 and r["avg_b"] == 40 and r["k"] == "p_t"


def test_legacy_key_collision_t4(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c")], "x string, y string")
    assert rep.composite_counts(df, "x", "y").count() == 2
    merged = rep.composite_counts(df, "x", "y", legacy_key=True).collect()
    assert len(merged) == 1 and merged[0]["count"] == 2


def test_js_object_key_order_t7(spark):
    rows = [(1, "x"), (2, "101"), (3, "보4"), (4, "거2"), (5, "7"), (6, "007")]
    df = spark.createDataFrame(rows, "ts long, id string")
    out = [r["id"] for r in rep.top_frequencies(df, "id", 10, ["ts"]).collect()]
    # ties: integer-like keys ascending first, then the rest newest first
    assert out == ["7", "101", "007", "거2", "보4", "x"]


def test_sample_before_count_t2(spark):
    rows = [(i, "a" if i < 5 else "b") for i in range(10)]
    df = spark.createDataFrame(rows, "ts long, id string")
    out = rep.top_frequencies(df, "id", 10, ["ts"], sample_n=3).collect()
    assert [(r["id"], r["n_uses"]) for r in out] == [("b", 3)]


def test_nulls_order_t1(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "k string, r double")
    out = [r["k"] for r in df.orderBy(F.desc_nulls_first("r")).collect()]
    assert out == ["b", "c", "a"]


def test_hazard_first_seen_category(spark):
    rows = [(3, "lamp", "B", "Y"), (1, "lamp", "A", None), (2, "pole", "C", "N")]
    df = spark.createDataFrame(rows, "k long, label string, category string, is_defect string")
    got = {r["label"]: r for r in rep.label_stats(df, "label", "category", "is_defect", "k").collect()}
    assert got["lamp"]["category"] == "A" and got["lamp"]["count"] == 2 and got["lamp"]["defect_count"] == 1


def test_violation_total_row(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "t string, s string")
    rows = rep.counts_with_total(df, ["t", "s"]).collect()
    total = [r for r in rows if r["is_total"]]
    assert len(total) == 1 and total[0]["cnt"] == 3
    assert any(r["t"] is None and not r["is_total"] for r in rows)


# ------------------------------------------------------------- T8, T10, T13, T16

def test_falsy_vs_nullish_t8(spark):
    df = spark.createDataFrame([(0, ""), (None, None), (5, "x")], "n int, s string")
    from pyspark.sql.types import IntegerType

    out = df.select(js.falsy_default("s", "d").alias("f"),
                    js.falsy_default("n", 9, IntegerType()).alias("fn"),
                    js.nullish_default("n", F.lit(9)).alias("q")).collect()
    assert [r["f"] for r in out] == ["d", "d", "x"]
    assert [r["fn"] for r in out] == [9, 9, 5]
    assert [r["q"] for r in out] == [0, 9, 5]


def test_analysis_record_defaults(spark):
    df = spark.createDataFrame([("101", "", 0, None, "x" * 10050)],
                               "diagram_id string, input_type string, match_score int, session_id string, input_text string")
    r = ing.shape_analysis_records(df).first()
    assert r["input_type"] == "text" and r["match_score"] == 0 and r["session_id"] is None
    assert r["confidence"] == "하" and r["label_a"] == "A" and r["has_pdf"] is False
    assert len(r["input_text"]) == 10000


def test_code_points_t10(spark):
    df = spark.createDataFrame([("😀abc",)], "t string")
    assert df.select(F.length("t").alias("n")).first()["n"] == 4


def test_clamp_null_t13(spark):
    df = spark.createDataFrame([(95, 20), (5, -10), (None, 5)], "b int, m int")
    out = one(df.select(js.clamp(F.col("b") + F.col("m")).alias("x")), "x")
    assert out == [100, 0, None]


def test_modifier_array_fixture(spark):
    t = "array<struct<name:string,target:string,value:int,reason:string>>"
    df = spark.createDataFrame([(95, [("drunk", "A", 20, "r")]), (5, [("x", "A", -10, "r"), ("y", "B", 5, "r")]),
                                (None, [("z", "A", 5, "r")]), (50, None)], f"base int, mods {t}")
    out = one(df.select(rul.apply_modifier_array("base", "mods", "A").alias("fa")), "fa")
    assert out == [100, 0, None, 50]


def test_agreement_t16(spark):
    df = spark.createDataFrame([(None, None), (101, 101), (101, None), (0, None)], "a long, b long")
    same, both = ses.agreement("a", "b", numeric=True)
    out = [(r["s"], r["p"]) for r in df.select(same.alias("s"), both.alias("p")).collect()]
    assert out == [(True, False), (True, True), (False, False), (True, False)]
    strings = spark.createDataFrame([("0", None), ("", None), ("0", "0")], "a string, b string")
    same, both = ses.agreement("a", "b")
    out = [(r["s"], r["p"]) for r in strings.select(same.alias("s"), both.alias("p")).collect()]
    assert out == [(False, False), (True, False), (True, True)]  # the string '0' is truthy


# ------------------------------------------------------------- T11, T12, T25

def test_unicode_split_t11(spark):
    df = spark.createDataFrame([("신호　교차로, a",)], "k string")
    assert df.select(search_words("k").alias("w")).first()["w"] == ["신호", "교차로"]


def test_ilike_wildcards_t12(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("100%",)], "k string")
    assert df.where(ilike_contains("k", "a_b")).count() == 2
    assert df.where(ilike_contains("k", "a_b", literal=True)).count() == 1
    assert df.where(ilike_contains("k", "0%", literal=True)).count() == 1


def test_limit_parse_t25():
    assert [srch.resolve_limit(x) for x in ["0", "x", "99", "7abc", None, 0, 20, "-3"]] == [10, 10, 50, 7, 10, 10, 20, 1]


def test_bound_zero_applies(spark):
    df = spark.createDataFrame([(1, 0, "k", "c", "ct", "1:99", 1.0), (2, 5, "k", "c", "ct", "5:95", 2.0)],
                               "id long, fault_a int, keywords_text string, categories string, court string, "
                               "fault_ratio string, relevance_score double")
    out = srch.search(df, srch.SearchRequest(fault_max="0")).collect()
    assert [r["id"] for r in out] == [1]


def test_batch_search_top_k_per_request(spark):
    rows = [(i, 10, f"w{i % 3} blue", "c", "ct", "10:90", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, fault_a int, keywords_text string, categories string, court string, "
                                     "fault_ratio string, relevance_score double")
    reqs = {1: srch.SearchRequest(keywords="w1", limit="3"), 2: srch.SearchRequest(keywords="x", limit="2")}
    out = srch.search_batch(df, reqs).collect()
    got = {}
    for r in out:
        got.setdefault(r["request_id"], []).append(r["id"])
    assert sorted(got[1]) == [22, 25, 28] and sorted(got[2]) == [28, 29]


# ------------------------------------------------------------- T15, upsert

def test_upsert_duplicate_key_fails_t15(spark):
    tgt = spark.createDataFrame([(1, "a")], "k long, v string")
    src = spark.createDataFrame([(2, "b"), (2, "c")], "k long, v string")
    with pytest.raises(ups.DuplicateKeyError):
        ups.upsert(tgt, src, "k")


def test_upsert_last_wins_and_null_keys(spark):
    tgt = spark.createDataFrame([(1, "a", 0), (None, "n", 0)], "k long, v string, o int")
    src = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (3, "d", 1), (None, "m", 1)], "k long, v string, o int")
    out = sorted((r["k"] or -1, r["v"]) for r in ups.upsert(tgt.drop("o"), src, "k", "last", ["o"]).collect())
    assert out == [(-1, "m"), (-1, "n"), (1, "c"), (3, "d")]


def test_orphans_and_cascade(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, fk long")
    assert one(ups.orphans(child, parent, "fk", "id"), "cid") == [11]
    deleted = spark.createDataFrame([(1,)], "id long")
    assert sorted(one(ups.cascade_delete(child, deleted, "fk", "id"), "cid")) == [11, 12]


# ------------------------------------------------------------- T18 reply repair

REPLIES = [
    ('{"a":1}', True, 1),
    ('```json\n{"a":2}\n```', True, 2),
    ('Here: {"a":3} done', True, 3),
    ('{"a":4} tail', True, 4),
    ('{"a":1} {"b":2}', False, None),
    ('{"a":5,"a":6}', True, 6),
    ("", False, None),
    ('{"a":', False, None),
]


def test_reply_repair_t18(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(REPLIES)], "i int, content string")
    out = rpl.repair(df, "content").select("i", "parse_ok", F.try_variant_get("reply", "$.a", "int").alias("a"),
                                           "error", "raw").orderBy("i").collect()
    for r, (content, ok, a) in zip(out, REPLIES):
        assert r["parse_ok"] is ok, content
        assert r["a"] == a, content
        if not ok:
            assert r["error"] == rpl.PARSE_ERROR and r["raw"] == content


def test_typed_reply_fields(spark):
    txt = ('{"diagram_id":"106","confidence":"85","fault_a":30,"fault_b":70,'
           '"modifier_detail":[{"name":"야간","target":"A","value":5,"reason":"r"}]}')
    df = rpl.repair(spark.createDataFrame([(txt,)], "content string"), "content")
    r = df.select(*rpl.typed_fields("reply")).first()
    assert r["diagram_id"] == "106" and r["confidence"] == 85 and r["fault_a"] == 30
    assert r["modifier_detail"][0]["value"] == 5 and r["label_a"] is None


# ------------------------------------------------------------- T21, T22 rules

TEXTS = [
    ("무신호 교차로에서 직진 중 충돌", "차대차", "교차로무신호"),
    ("신호 대기 후 출발, 앞차 추돌", "차대차", "교차로신호"),
    ("주차장에서 후진 중 신호 무시 차량과 충돌", "차대차", "기타"),
    ("유턴하던 차량과 충돌", "차대차", "기타"),
    ("자전거와 보행자 충돌", "차대자전거", "기타자전거"),
    ("횡단보도 보행자 사고", "차대사람", "횡단보도"),
    ("어린이 보호구역", "차대사람", "기타보행"),
    ("고속도로 갓길 정차", "차대차", "고속도로"),
    ("아무 키워드 없음", "차대차", None),
]


def test_keyword_classification_t21(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "i int, text string")
    c = rul.classify(df, "text")
    sc = rul.subclassify(c, "text", "category").orderBy("i").collect()
    for r, (t, cat, sub) in zip(sc, TEXTS):
        assert (r["category"], r["subcategory"]) == (cat, sub), t


def test_range_check_t22(spark):
    rows = [("차대자전거", "거5"), ("차대자전거", "거27"), ("차대사람", "101"), ("차대차", "610"), ("차대차", "x")]
    df = spark.createDataFrame(rows, "cat string, did string")
    pre, num = rul.split_diagram_id("did")
    ok, reason = rul.range_check(F.col("cat"), pre, num, rul.category_ranges())
    out = [(r["ok"], r["reason"]) for r in df.select(ok.alias("ok"), reason.alias("reason")).collect()]
    assert out == [(True, None), (False, "out_of_range"), (False, "out_of_range"), (True, None), (False, "bad_id")]


def test_title_parse_and_party_swap(spark):
    df = spark.createDataFrame([("106: 직진 vs 비보호좌회전 (A30:B70)",), ("녹색직진 vs 적색직진",)], "title string")
    p = rul.parse_title("title")
    out = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert tuple(out[0]) == ("106", "직진", "비보호좌회전", 30, 70)
    assert (out[1]["label_a"], out[1]["label_b"], out[1]["base_fault_a"]) == ("녹색직진", "적색직진", None)
    users = spark.createDataFrame([("비보호좌회전", "직진", 70, 30)], "ua string, ub string, fa int, fb int")
    al = rul.align_parties(F.col("ua"), F.col("ub"), F.lit("직진"), F.lit("비보호좌회전"), F.col("fa"), F.col("fb"))
    r = users.select(*[v.alias(k) for k, v in al.items()]).first()
    assert r["swapped"] and r["user_a_side"] == "B" and (r["fault_a"], r["fault_b"]) == (30, 70)


# ------------------------------------------------------------- rendering, cost

def test_report_modifier_fallbacks(spark):
    df = spark.createDataFrame([([], ["야간"]), (None, ["야간"]), (None, None)],
                               "m array<string>, d array<string>")
    out = one(df.select(rnd.join_or_none("m", "d").alias("x")), "x")
    assert out == ["없음", "야간", "없음"]


def test_report_null_prints_null(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert df.select(rnd.tmpl("x").alias("t")).first()["t"] == "null"


def test_cost_t20(spark):
    df = spark.createDataFrame([(1234, 567), (40000000, 0), (None, None)], "i long, o long")
    out = one(df.select(use.cost_usd("i", "o").alias("c")), "c")
    assert out == [Decimal("0.012207"), None, Decimal("0.000000")]


def test_salted_hash(spark):
    import hashlib

    df = spark.createDataFrame([("1.2.3.4",), (None,)], "ip string")
    out = one(df.select(ing.salted_hash("ip", "s").alias("h")), "h")
    assert out == [hashlib.sha256(b"1.2.3.4s").hexdigest()[:16], hashlib.sha256(b"s").hexdigest()[:16]]
    with pytest.raises(ValueError):
        ing.salted_hash("ip", "")


def test_length_gate(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("x" * 10001,), (None,)], "t string")
    assert one(df.select(ing.length_gate("t").alias("g")), "g") == ["too_short", "ok", "too_long", "too_short"]


# ------------------------------------------------------------- sessions

def test_asof_matches_brute_force_with_hot_key(spark):
    import random

    random.seed(3)
    left = [(random.choice([1, 1, 1, 2, 3]), t, 1000 + t) for t in range(0, 400, 3)]
    right = [(random.choice([1, 1, 2, 3, 4]), t, 2000 + t) for t in range(1, 400, 5)]
    L = spark.createDataFrame(left, "u long, ts long, lid long")
    R = spark.createDataFrame(right, "u long, ts long, rid long")
    out = ses.asof_attach(R, L, "u", "ts", ["lid"], chunk=lambda c: (c / 50).cast("long"), tiebreak="lid")
    got = {r["rid"]: r["match_lid"] for r in out.collect()}
    want = {}
    for u, t, rid in right:
        cands = [(lt, lid) for lu, lt, lid in left if lu == u and lt <= t]
        if cands:
            want[rid] = max(cands)[1]
    assert got == want


def test_latest_and_mark_used(spark):
    a = spark.createDataFrame([("s1", 1, 10), ("s1", 2, 20), ("s2", 3, 5)], "session string, id long, ts long")
    res = spark.createDataFrame([("s1", "r1"), ("s3", "r3")], "session string, rid string")
    att = ses.attach_to_latest(res, a, "session", ["ts", "id"], "id").collect()
    assert [(r["rid"], r["analysis_id"]) for r in att] == [("r1", 2)]
    used = {r["id"]: r["llm_used"] for r in ses.mark_used(a, spark.createDataFrame(att), "id").collect()}
    assert used == {1: False, 2: True, 3: False}


# ------------------------------------------------------------- JSON ingest

def test_video_flatten_shapes(spark):
    recs = [
        '{"video":{"video_name":"a","accident_negligence_rateA":0,"traffic_accident_type":7,"filming_way":""}}',
        '{"video_name":"b","accident_type":3,"has_mp4":true,"weather":"rain"}',
        '{"video":null,"video_name":"c"}',
        'not json',
    ]
    df = spark.createDataFrame([(r,) for r in recs], "raw_json string")
    out = ing.flatten_video_records(df).collect()
    assert (out[0]["video_name"], out[0]["rate_a"], out[0]["accident_type"], out[0]["filming_way"]) == ("a", 0, 7, None)
    assert (out[1]["video_name"], out[1]["accident_type"], out[1]["has_mp4"], out[1]["weather"]) == ("b", 3, True, "rain")
    assert out[2]["video_name"] == "c" and out[2]["has_mp4"] is False
    assert out[3]["video_name"] is None and out[3]["raw_json"] == "not json"


def test_validate_split(spark):
    df = spark.createDataFrame([("x", "en"), ("", "en"), ("y", "zz")], "text string, lang string")
    tagged = ing.validate(df, [("missing_text", ing.required("text")), ("bad_lang", ing.in_domain("lang", ["en"]))])
    assert one(tagged, "reject_reason") == [None, "missing_text", "bad_lang"]
    assert ing.valid_rows(tagged).count() == 1 and ing.quarantined_rows(tagged).count() == 2


def test_upsert_summary(spark):
    tgt = spark.createDataFrame([(1,), (2,)], "k long")
    src = spark.createDataFrame([(2, 1), (2, 2), (5, 1)], "k long, o int")
    written = ups.dedupe_last(src, "k", ["o"])
    r = ups.upsert_summary(tgt, src, "k", written=written).first()
    assert (r["total_sent"], r["uploaded"], r["inserted"], r["updated"]) == (3, 2, 1, 1)


def test_row_counts(spark):
    a = spark.range(5)
    b = spark.range(7)
    r = rep.row_counts(x=a, y=b).first()
    assert (r["x"], r["y"]) == (5, 7)


def test_histogram_top(spark):
    df = spark.createDataFrame([(50, 50)] * 3 + [(30, 70)] * 2 + [(20, 80)], "a int, b int")
    out = [(r["ratio"], r["cases"]) for r in rep.ratio_histogram(df, "a", "b", top_n=2).collect()]
    assert out == [("50:50", 3), ("30:70", 2)]


def test_fixture_row():
    assert Row(a=1)["a"] == 1


def test_js_truthiness_of_wrapper(spark):
    from faultline.functions import jsonx as jx

    cases = [('{"video":{}}', True), ('{"video":[]}', True), ('{"video":"0"}', True), ('{"video":"false"}', True),
             ('{"video":0}', False), ('{"video":0.0}', False), ('{"video":false}', False), ('{"video":""}', False),
             ('{"video":null}', False), ('{"x":1}', False), ('{"video":-1}', True), ('{"video":true}', True)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, j string")
    inner = F.try_variant_get(F.try_parse_json("j"), "$.video", "variant")
    out = one(df.orderBy("i").select(jx.js_truthy(inner).alias("t")), "t")
    assert out == [t for _, t in cases]


def test_llm_record_shape_t8(spark):
    df = spark.createDataFrame([("101", "101", 0, 0, "x" * 6000, 0), ("", "0", None, 85, None, None)],
                               "llm_diagram_id string, engine_diagram_id string, llm_fault_a int, "
                               "llm_confidence int, llm_reasoning string, llm_tokens int")
    out = ing.shape_llm_records(df).collect()
    a, b = out
    assert (a["llm_diagram_id"], a["llm_fault_a"], a["llm_confidence"], a["llm_tokens"]) == ("101", 0, None, 0)
    assert len(a["llm_reasoning"]) == 5000 and a["matches_engine"] is True and a["llm_modifiers"] == []
    assert (b["llm_diagram_id"], b["llm_fault_a"], b["llm_confidence"], b["llm_reasoning"]) == (None, None, 85, "")
    assert b["matches_engine"] is False  # '' prints as '', the string '0' stays '0'


def test_table_defaults_only_fill_omitted_columns(spark):
    df = spark.createDataFrame([(None,)], "expert_level string")
    r = ing.table_defaults(df, {"expert_level": "user", **ing.PRECEDENT_DEFAULTS}).first()
    assert r["expert_level"] is None and r["confidence"] == 50 and r["verified"] is False and r["source"] == "user"


def test_update_by_key_k8(spark):
    tgt = spark.createDataFrame([(1, "a", False), (2, "b", False), (None, "n", False)], "id long, v string, used boolean")
    upd = spark.createDataFrame([(1, None, True, 1), (1, "x", True, 2), (9, "z", True, 1)],
                                "id long, v string, used boolean, seq int")
    out = sorted((r["id"] or -1, r["v"], r["used"]) for r in ses.update_by_key(tgt, upd, "id", ["v", "used"], ["seq"]).collect())
    assert out == [(-1, "n", False), (1, "x", True), (2, "b", False)]
    upd2 = spark.createDataFrame([(2, None)], "id long, v string")
    out2 = {r["id"]: r["v"] for r in ses.update_by_key(tgt, upd2, "id", ["v"]).collect()}
    assert out2[2] is None and out2[1] == "a"


def test_time_chunker_sizes_chunks(spark):
    import datetime as dt

    from faultline.functions.chunks import time_chunker

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=37 * i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    f = time_chunker(df, "ts", rows_per_chunk=100)
    got = df.select(f(F.col("ts")).alias("c")).groupBy("c").count().collect()
    assert 10 <= len(got) <= 40 and max(r["count"] for r in got) <= 100
    ids = [r["c"] for r in df.orderBy("ts").select(f(F.col("ts")).alias("c")).collect()]
    assert ids == sorted(ids)  # monotone in time


def test_numeric_zero_bound_is_falsy_t25():
    from faultline.operators.search import _bound

    assert [_bound(x) for x in ["0", 0, 0.0, "", None, "12x", 7, "x"]] == [0, None, None, None, None, 12, 7, None]


def test_analysis_lists_and_ip_hash(spark):
    import hashlib

    df = spark.createDataFrame([("101", "1.2.3.4", ["야간"]), ("102", None, None)],
                               "diagram_id string, ip string, detected_mods array<string>")
    rows = ing.shape_analysis_records(df, salt="s").orderBy("diagram_id").collect()
    assert rows[0]["detected_mods"] == ["야간"] and rows[1]["detected_mods"] == []
    assert rows[0]["alt_diagrams"] == [] and rows[0]["laws"] == []
    assert rows[0]["ip_hash"] == hashlib.sha256(b"1.2.3.4s").hexdigest()[:16]
    assert rows[1]["ip_hash"] == hashlib.sha256(b"s").hexdigest()[:16]
    assert "ip" not in rows[0].asDict()


def test_keyword_index_all_and_any(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["a", "a"]), (4, None)], "id long, kw array<string>")
    idx = srch.keyword_index(df, "id", "kw")
    assert sorted(one(srch.index_lookup(idx, ["a", "b"], "id", "all"), "id")) == [1]
    assert sorted(one(srch.index_lookup(idx, ["a", "b"], "id", "any"), "id")) == [1, 2, 3]
    assert sorted(one(srch.array_keyword_match(df, "kw", ["a", "b"], "all"), "id")) == [1]


def test_utf16_length_t10(spark):
    df = spark.createDataFrame([("😀abc",), ("가나",), ("",)], "t string")
    out = [(r["cp"], r["u16"]) for r in df.select(F.length("t").alias("cp"), js.utf16_length("t").alias("u16")).collect()]
    assert out == [(4, 5), (2, 2), (0, 0)]
    g = spark.createDataFrame([("😀😀a",)], "t string")  # 3 code points, 5 UTF-16 units
    assert g.select(ing.length_gate("t").alias("a"), ing.length_gate("t", units="utf16").alias("b")).first() == ("too_short", "ok")


def test_js_whitespace_class_t11(spark):
    df = spark.createDataFrame([("a﻿bb\u0085cc　dd",)], "k string")
    # BOM and U+3000 split (JavaScript \s); U+0085 does not
    assert df.select(search_words("k", 1).alias("w")).first()["w"] == ["a", "bb\u0085cc", "dd"]
    t = spark.createDataFrame([("﻿ x 　",)], "t string")
    assert t.select(js.js_trim("t").alias("r")).first()["r"] == "x"
    from faultline.functions.text import split_words_py

    assert split_words_py("a﻿bb\u0085cc　dd", 1) == ["a", "bb\u0085cc", "dd"]


def test_fixture_category_lookup_default_and_null_code(spark):
    df = spark.createDataFrame([("1st", "B"), ("1st", None), ("1st", "A"), ("2nd", "C")], "tier string, code string")
    df = df.withColumn("k", F.monotonically_increasing_id())
    out = [r["code"] for r in rep.lookup_sorted(df, "tier", None, "code", "k", default="1st").collect()]
    assert out == ["A", "B", None]


def test_fixture_empty_diagram_not_counted(spark):
    df = spark.createDataFrame([("", True), (None, True), ("101", False)], "d string, is_correct boolean")
    got = {r["d"]: (r["total_count"], r["accuracy_rate"]) for r in acc.accuracy_by_key(df, "d").collect()}
    assert got == {"101": (1, 0.0)}


def test_fixture_precedent_nulls_and_wildcards(spark):
    rows = [(1, 10, "a_b", "c", "ct", "10:90", None), (2, 10, "axb", "c", "ct", "10:90", 5.0),
            (3, 10, "a_b", "c", "ct", None, 9.0), (4, 10, "zz", "c", "ct", "10:90", 7.0)]
    df = spark.createDataFrame(rows, "id long, fault_a int, keywords_text string, categories string, court string, "
                                     "fault_ratio string, relevance_score double")
    got = [r["id"] for r in srch.search(df, srch.SearchRequest(keywords="a_b")).collect()]
    assert got == [1, 2]  # null relevance first (DESC), '_' is a wildcard, null fault_ratio excluded
    got = [r["id"] for r in srch.search(df, srch.SearchRequest(keywords="a_b", literal=True)).collect()]
    assert got == [1]


def test_time_chunker_splits_hot_hour(spark):
    import datetime as dt

    from faultline.functions.chunks import time_chunker

    base = dt.datetime(2024, 1, 1)
    # 600 rows spread over 10 days, plus 600 rows inside one hour (half of everything)
    rows = [(i, base + dt.timedelta(minutes=24 * i)) for i in range(600)]
    rows += [(1000 + i, base + dt.timedelta(days=3, seconds=6 * i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    f = time_chunker(df, "ts", rows_per_chunk=100)
    sizes = [r["count"] for r in df.groupBy(f(F.col("ts")).alias("c")).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1200


def test_envelope_k9(spark):
    import json

    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0), (4, 1.0)], "id long, relevance_score double")
    r = rep.envelope(df, 3, F.desc_nulls_first("relevance_score"), F.asc("id")).first()
    assert r["count"] == 3
    assert [x["id"] for x in json.loads(r["results"])] == [2, 3, 1]


def test_fault_sum_violations_flags_missing_share(spark):
    df = spark.createDataFrame([(1, 30, 70), (2, 30, 71), (3, None, 100)], "id long, a int, b int")
    assert sorted(one(rep.fault_sum_violations(df, "a", "b"), "id")) == [2, 3]
    assert rep.ratio_histogram(df, "a", "b", top_n=None).count() == 3  # 30:70, 30:71 and the null ratio


def test_chunked_windows_do_not_depend_on_size_nulls_or_outliers(spark):
    """W3 and J3 with null keys, null times and a date in year 9999: many chunks equal one."""
    import datetime as dt

    from faultline.functions.chunks import time_chunker

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 11 == 0 else i % 3, None if i % 13 == 0 else t0 + dt.timedelta(seconds=i), i % 2 == 0) for i in range(4000)]
    rows.append((4000, 1, dt.datetime(9999, 1, 1), True))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, ok boolean")
    many = time_chunker(df, "ts", rows_per_chunk=100)
    sizes = [r["count"] for r in df.groupBy(many(F.col("ts")).alias("c")).count().collect()]
    assert len(sizes) > 30 and max(s for s in sizes if s != sum(r[2] is None for r in rows)) <= 128
    one = lambda c: F.lit(0).cast("long")
    run = lambda f: sorted(tuple(r) for r in acc.running_accuracy(df, ["k"], ["ts", "id"], "ok", f(F.col("ts"))).select("id", "n_seen", "n_ok").collect())
    assert run(many) == run(one) and len(run(many)) == len(rows)
    left, right = df.where("ok"), df.where("NOT ok")
    att = lambda f, how: sorted((r["id"], r["match_id"] if r["match_id"] is not None else -1) for r in ses.asof_attach(
        right, left, "k", "ts", ["id"], chunk=f, tiebreak="id", how=how).collect())
    assert att(many, "inner") == att(one, "inner") and att(many, "left") == att(one, "left")
    assert len(att(many, "left")) == right.count()
    bare = {r[0] for r in rows if r[1] is None or r[2] is None}
    assert not [i for i, m in att(many, "inner") if i in bare or m in bare]


def test_reply_with_text_behind_the_value_is_rejected(spark):
    rows = [('{"a":1}] {"b":2}', None), ('{"a":1}] x', 1), ('{"a":1}} x', None), ('{"a":1},{"b":2}', None), ('{"a":1}', 1), ('[1] ]', None), ('x {"a":1} y', 1)]
    out = rpl.repair(spark.createDataFrame([(t,) for t, _ in rows], "content string"), "content")
    got = {r["content"]: r["a"] for r in out.select("content", F.try_variant_get("reply", "$.a", "int").alias("a")).collect()}
    assert got == {'{"a":1}] {"b":2}': None, '{"a":1}] x': 1, '{"a":1}} x': None, '{"a":1},{"b":2}': None, '{"a":1}': 1, "[1] ]": None, 'x {"a":1} y': 1}


def test_variant_response_can_be_stored_by_mark_used(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    att = spark.createDataFrame([(1, 5, '{"r":1}'), (1, 7, '{"r":2}')], "analysis_id long, at int, j string").select("analysis_id", "at", F.parse_json("j").alias("llm_response"))
    for order in (["at"], None):
        got = {r["id"]: (r["llm_used"], r["j"]) for r in ses.mark_used(a, att, "id", response="llm_response", order=order).select("id", "llm_used", F.to_json("llm_response").alias("j")).collect()}
        assert got == {1: (True, '{"r":2}'), 2: (False, None)}
