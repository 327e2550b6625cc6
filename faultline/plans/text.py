"""Text jobs around the model, bound to the driver tables.

Replies are JSON texts built from conversations / part rows (the tables
have no braces or fences of their own), keyword rules run on documents,
diagram titles and ranges on part, modifiers on lineitem, usage on
conversations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render as rnd
from ..operators import replies as rpl
from ..operators import rule_tables as tbl
from ..operators import rules as rul
from ..operators import usage as use
from ..sources.tables import Tables
from .registry import register

s = lambda c: c.cast("string")

# ------------------------------------------------------------------ replies

def reply_texts(spark, sf_dir):
    """Model replies per conversation turn, shaped by conv_id % 4:
    plain, fenced, wrapped in prose, cut off."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text")
    obj = F.concat(F.lit('{"conv_id":'), s(F.col("conv_id")), F.lit(',"turn":'), s(F.col("turn")),
                   F.lit(',"role":"'), F.col("role"), F.lit('","n":'), s(F.length("text")), F.lit("}"))
    kind = F.col("conv_id") % 6
    content = (F.when(kind == 0, obj)
                .when(kind == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
                .when(kind == 2, F.concat(F.lit("Result: "), obj, F.lit(" -- end")))
                .when(kind == 4, F.concat(obj, F.lit("] "), obj))  # text after the value, twice over
                .when(kind == 5, F.concat(obj, F.lit("] x")))
                .otherwise(F.concat(F.lit('{"conv_id":'), s(F.col("conv_id")), F.lit(',"turn":'))))
    return c.select("conv_id", "turn", kind.alias("kind"), content.alias("content"))


REPLY_SQL = r"""
r AS (
  SELECT conv_id, turn, conv_id % 6 AS kind,
    CASE conv_id % 6
      WHEN 0 THEN obj
      WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```'
      WHEN 2 THEN 'Result: ' || obj || ' -- end'
      WHEN 4 THEN obj || '] ' || obj
      WHEN 5 THEN obj || '] x'
      ELSE '{"conv_id":' || CAST(conv_id AS VARCHAR) || ',"turn":' END AS content
  FROM (SELECT conv_id, turn, '{"conv_id":' || CAST(conv_id AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR)
               || ',"role":"' || role || '","n":' || CAST(length(text) AS VARCHAR) || '}' AS obj FROM conversations)
),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(content, '```json\s*', '', 'g'), '```\s*', '', 'g'),
                           '^\s+|\s+$', '', 'g') AS clean FROM r
),
c2 AS (SELECT *, regexp_extract(clean, '\{[\s\S]*\}') AS span FROM c),
c3 AS (
  SELECT *,
    CASE WHEN json_valid('[' || clean || ']') AND json_array_length('[' || clean || ']') = 1
           THEN json_extract('[' || clean || ']', '$[0]')
         WHEN span <> '' AND json_valid('[' || span || ']') AND json_array_length('[' || span || ']') = 1
           THEN json_extract('[' || span || ']', '$[0]') END AS body
  FROM c2
)"""


@register("llm_json_repair", f"""WITH {REPLY_SQL}
SELECT conv_id, turn, kind, body IS NOT NULL AS parse_ok,
  TRY_CAST(json_extract_string(body, '$.conv_id') AS BIGINT) AS r_conv_id,
  TRY_CAST(json_extract_string(body, '$.turn') AS BIGINT) AS r_turn,
  json_extract_string(body, '$.role') AS r_role,
  TRY_CAST(json_extract_string(body, '$.n') AS INTEGER) AS r_n,
  CASE WHEN body IS NULL THEN 'JSON 파싱 실패' END AS error,
  CASE WHEN body IS NULL THEN content END AS raw
FROM c3""")
def llm_json_repair(spark, sf_dir):
    rep = rpl.repair(reply_texts(spark, sf_dir), "content")
    v = F.col("reply")
    return rep.select("conv_id", "turn", "kind", "parse_ok",
                      F.try_variant_get(v, "$.conv_id", "bigint").alias("r_conv_id"),
                      F.try_variant_get(v, "$.turn", "bigint").alias("r_turn"),
                      F.try_variant_get(v, "$.role", "string").alias("r_role"),
                      F.try_variant_get(v, "$.n", "int").alias("r_n"),
                      "error", "raw")


def typed_reply_texts(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_type", "p_size")
    conf = F.when(F.col("p_size") % 2 == 0, s(F.col("p_size") * 2)) \
            .otherwise(F.concat(F.lit('"'), s(F.col("p_size") * 2), F.lit('"')))
    txt = F.concat(
        F.lit('{"step1_category":"'), F.col("p_type"),
        F.lit('","diagram_id":"'), s(F.col("p_size") + 100),
        F.lit('","diagram_title":"'), F.col("p_brand"), F.lit(" vs "), F.col("p_type"),
        F.lit('","confidence":'), conf,
        F.lit(',"fault_a":'), s(F.col("p_size")), F.lit(',"fault_b":'), s(F.lit(100) - F.col("p_size")),
        F.lit(',"label_a":"'), F.col("p_brand"), F.lit('","label_b":"'), F.col("p_type"),
        F.lit('","detected_modifiers":["night","speed"],"modifier_detail":[{"name":"night","target":"A","value":'),
        s(F.col("p_size") % 10), F.lit(',"reason":"dark"}]}'))
    return p.select("p_partkey", txt.alias("content"))


@register("llm_reply_typed", """
WITH r AS (
  SELECT p_partkey, CAST(
    '{"step1_category":"' || p_type || '","diagram_id":"' || CAST(p_size + 100 AS VARCHAR)
    || '","diagram_title":"' || p_brand || ' vs ' || p_type || '","confidence":'
    || CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 2 AS VARCHAR) ELSE '"' || CAST(p_size * 2 AS VARCHAR) || '"' END
    || ',"fault_a":' || CAST(p_size AS VARCHAR) || ',"fault_b":' || CAST(100 - p_size AS VARCHAR)
    || ',"label_a":"' || p_brand || '","label_b":"' || p_type
    || '","detected_modifiers":["night","speed"],"modifier_detail":[{"name":"night","target":"A","value":'
    || CAST(p_size % 10 AS VARCHAR) || ',"reason":"dark"}]}' AS JSON) AS body
  FROM part
)
SELECT p_partkey,
  json_extract_string(body, '$.step1_category') AS step1_category,
  json_extract_string(body, '$.diagram_id') AS diagram_id,
  json_extract_string(body, '$.diagram_title') AS diagram_title,
  TRY_CAST(json_extract_string(body, '$.confidence') AS INTEGER) AS confidence,
  TRY_CAST(json_extract_string(body, '$.fault_a') AS INTEGER) AS fault_a,
  TRY_CAST(json_extract_string(body, '$.fault_b') AS INTEGER) AS fault_b,
  json_extract_string(body, '$.label_a') AS label_a,
  json_extract_string(body, '$.label_b') AS label_b,
  CAST(json_array_length(body, '$.detected_modifiers') AS INTEGER) AS n_detected,
  TRY_CAST(json_extract_string(body, '$.modifier_detail[0].value') AS INTEGER) AS first_modifier_value
FROM r""")
def llm_reply_typed(spark, sf_dir):
    rep = rpl.repair(typed_reply_texts(spark, sf_dir), "content")
    typed = rep.select("p_partkey", *rpl.typed_fields("reply", [
        "step1_category", "diagram_id", "diagram_title", "confidence", "fault_a", "fault_b",
        "label_a", "label_b", "detected_modifiers", "modifier_detail"]))
    return typed.select("p_partkey", "step1_category", "diagram_id", "diagram_title", "confidence",
                        "fault_a", "fault_b", "label_a", "label_b",
                        F.size("detected_modifiers").cast("int").alias("n_detected"),
                        F.col("modifier_detail")[0]["value"].alias("first_modifier_value"))


# --------------------------------------------------------------- keyword rules

# Rules for the driver documents (English/French/German/Spanish prose):
# 'ation' shadows 'tion' on the same level, as '무신호' shadows '신호'.
DOC_RULES = [
    rul.KeywordRule("marked", 1, ("schst",)),
    rul.KeywordRule("noun", 2, ("tion",)),
    rul.KeywordRule("long_noun", 2, ("ation",)),
    rul.KeywordRule("adverb", 3, ("ment", "que")),
]
DOC_SUBRULES = {
    "noun": ([rul.KeywordRule("noun_en", 1, ("the",)), rul.KeywordRule("noun_fr", 1, ("les",))], "noun_other"),
    "adverb": ([rul.KeywordRule("adv_fr", 1, ("que",))], "adv_other"),
}
DOC_RANGES = {"noun_en": ("N", 1, 10), "noun_fr": ("N", 11, 20), "noun_other": ("N", 21, 30),
              "adv_fr": ("V", 1, 5), "adv_other": ("V", 6, 9)}

_CLASSIFY_SQL = """
CASE WHEN instr(text, 'schst') > 0 THEN 'marked'
     WHEN instr(text, 'ation') > 0 THEN 'long_noun'
     WHEN instr(text, 'tion') > 0 THEN 'noun'
     WHEN instr(text, 'ment') > 0 THEN 'adverb'
     WHEN instr(text, 'que') > 0 THEN 'adverb'
     ELSE 'plain' END"""
_MATCHED_SQL = """
CASE WHEN instr(text, 'schst') > 0 THEN 'schst'
     WHEN instr(text, 'ation') > 0 THEN 'ation'
     WHEN instr(text, 'tion') > 0 THEN 'tion'
     WHEN instr(text, 'ment') > 0 THEN 'ment'
     WHEN instr(text, 'que') > 0 THEN 'que' END"""


@register("rule_classify", f"""
SELECT doc_id, {_CLASSIFY_SQL} AS category, {_MATCHED_SQL} AS matched_keyword FROM documents""")
def rule_classify(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return rul.classify(d, "text", DOC_RULES, default="plain").select("doc_id", "category", "matched_keyword")


@register("rule_subclassify", f"""
WITH c AS (SELECT doc_id, text, {_CLASSIFY_SQL} AS category FROM documents),
s AS (
  SELECT doc_id, category,
    CASE WHEN category = 'noun' THEN
           CASE WHEN instr(text, 'the') > 0 THEN 'noun_en' WHEN instr(text, 'les') > 0 THEN 'noun_fr' ELSE 'noun_other' END
         WHEN category = 'adverb' THEN
           CASE WHEN instr(text, 'que') > 0 THEN 'adv_fr' ELSE 'adv_other' END END AS subcategory
  FROM c
)
SELECT doc_id, category, subcategory,
  CASE subcategory WHEN 'noun_en' THEN 'N1~N10' WHEN 'noun_fr' THEN 'N11~N20' WHEN 'noun_other' THEN 'N21~N30'
                   WHEN 'adv_fr' THEN 'V1~V5' WHEN 'adv_other' THEN 'V6~V9' END AS id_range
FROM s""")
def rule_subclassify(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    c = rul.classify(d, "text", DOC_RULES, default="plain", matched=None)
    sc = rul.subclassify(c, "text", "category", DOC_SUBRULES)
    return sc.select("doc_id", "category", "subcategory",
                     rul.id_range_text("subcategory", DOC_RANGES).alias("id_range"))


# --------------------------------------------- the accident rules themselves

# Accident descriptions by source: every sub-type, the priority words and their overlaps.
ACCIDENTS = [
    '교차로에서 녹색 신호에 직진', '무신호 교차로 같은폭', '중앙선 침범 역주행', '차선변경 중 추돌', '합류 지점 진입로',
    '고속도로 본선', '주차장 후진', '유턴 중 신호 위반', '자전거 교차로 우회전', '바이크 추월',
    '자전거도로', '보행자 횡단보도', '무단횡단 어린이', '일시정지 무신호', '골목 개문',
    '톨게이트 가속차로', '정면충돌', '급정거 앞차', '갓길 졸음', '아무 말',
]
_ACCIDENT_SQL = ", ".join(f"'{x}'" for x in ACCIDENTS)


_ACCIDENT_RULES_SQL = f"""
WITH d AS (
  SELECT doc_id, list_extract([{_ACCIDENT_SQL}], CAST(substr(source, 4) AS INTEGER) % 20 + 1) || ' ' || coalesce(text, '') AS body,
         CASE lang WHEN 'en' THEN '101' WHEN 'fr' THEN '거3' WHEN 'de' THEN '보2' ELSE '610' END AS diagram_id
  FROM documents
),
k(cat, label, level, word) AS (VALUES
  ('', '차대자전거', 1, '자전거'), ('', '차대자전거', 1, '자전거도로'), ('', '차대자전거', 1, '바이크'), ('', '차대자전거', 1, '이륜'), ('', '차대사람', 2, '보행자'),
  ('', '차대사람', 2, '횡단보도'), ('', '차대사람', 2, '보행'), ('', '차대사람', 2, '무단횡단'), ('', '차대사람', 2, '어린이'), ('', '차대사람', 2, '보행중'),
  ('차대차', '교차로신호', 3, '교차로'), ('차대차', '교차로신호', 2, '녹색'), ('차대차', '교차로신호', 2, '적색'), ('차대차', '교차로신호', 2, '황색'), ('차대차', '교차로신호', 2, '신호'),
  ('차대차', '교차로신호', 3, '좌회전'), ('차대차', '교차로신호', 3, '우회전'), ('차대차', '교차로신호', 3, '비보호'), ('차대차', '교차로무신호', 2, '무신호'), ('차대차', '교차로무신호', 3, '같은폭'),
  ('차대차', '교차로무신호', 3, '넓은도로'), ('차대차', '교차로무신호', 3, '좁은도로'), ('차대차', '교차로무신호', 3, '일시정지'), ('차대차', '대향', 3, '중앙선'), ('차대차', '대향', 3, '대향'),
  ('차대차', '대향', 3, '역주행'), ('차대차', '대향', 3, '정면충돌'), ('차대차', '동행', 3, '차선변경'), ('차대차', '동행', 3, '추월'), ('차대차', '동행', 3, '같은방향'),
  ('차대차', '동행', 3, '앞차'), ('차대차', '동행', 3, '뒤차'), ('차대차', '동행', 3, '추돌'), ('차대차', '동행', 3, '급정거'), ('차대차', '합류', 3, '합류'),
  ('차대차', '합류', 3, '진입로'), ('차대차', '합류', 3, '톨게이트'), ('차대차', '합류', 3, '가속차로'), ('차대차', '고속도로', 3, '고속도로'), ('차대차', '고속도로', 3, '본선'),
  ('차대차', '고속도로', 3, '갓길'), ('차대차', '고속도로', 3, '졸음'), ('차대차', '기타', 1, '주차장'), ('차대차', '기타', 3, '주차'), ('차대차', '기타', 1, '후진'),
  ('차대차', '기타', 1, '출차'), ('차대차', '기타', 1, '개문'), ('차대차', '기타', 1, '유턴'), ('차대차', '기타', 3, '도로외'), ('차대차', '기타', 3, '골목'),
  ('차대자전거', '교차로자전거', 1, '교차로'), ('차대자전거', '교차로자전거', 1, '우회전'), ('차대자전거', '교차로자전거', 1, '좌회전'), ('차대자전거', '동행자전거', 2, '같은방향'), ('차대자전거', '동행자전거', 2, '추월'),
  ('차대사람', '횡단보도', 1, '횡단보도')),
r(cat, label, prefix, lo, hi) AS (VALUES
  ('차대차', '교차로신호', '', 101, 126), ('차대차', '교차로무신호', '', 201, 223), ('차대차', '대향', '', 301, 317), ('차대차', '동행', '', 401, 428),
  ('차대차', '합류', '', 501, 510), ('차대차', '고속도로', '', 551, 561), ('차대차', '기타', '', 601, 626), ('차대자전거', '교차로자전거', '거', 1, 7),
  ('차대자전거', '동행자전거', '거', 2, 21), ('차대자전거', '기타자전거', '거', 4, 26), ('차대사람', '횡단보도', '보', 1, 10), ('차대사람', '기타보행', '보', 11, 33)),
ko AS (SELECT *, row_number() OVER () AS i FROM k),
c AS (
  SELECT d.*, coalesce(w.label, '차대차') AS category, w.word AS matched_keyword FROM d LEFT JOIN (
    SELECT doc_id, label, word, row_number() OVER (PARTITION BY doc_id ORDER BY level, length(word) DESC, i) AS n
    FROM d JOIN ko ON cat = '' AND instr(body, word) > 0) w ON w.doc_id = d.doc_id AND w.n = 1
),
s AS (
  SELECT c.*, coalesce(w.label, CASE c.category WHEN '차대자전거' THEN '기타자전거' WHEN '차대사람' THEN '기타보행' END) AS subcategory
  FROM c LEFT JOIN (
    SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY level, length(word) DESC, i) AS n
    FROM c JOIN ko ON ko.cat = c.category AND instr(body, word) > 0) w ON w.doc_id = c.doc_id AND w.n = 1
),
x AS (SELECT *, regexp_extract(diagram_id, '^(\\D*)(\\d+)$', 1) AS pre, CAST(regexp_extract(diagram_id, '^(\\D*)(\\d+)$', 2) AS INTEGER) AS num,
             instr(body, '자전거') > 0 AS bike, instr(body, '보행자') > 0 OR instr(body, '횡단보도') > 0 AS foot,
             instr(body, '주차장') > 0 OR instr(body, '후진') > 0 OR instr(body, '출차') > 0 OR instr(body, '개문') > 0 AS lot FROM s)
SELECT doc_id, category, matched_keyword, subcategory,
  (SELECT r.prefix || r.lo || '~' || r.prefix || r.hi FROM r WHERE r.cat = x.category AND r.label = x.subcategory) AS id_range, diagram_id,
  EXISTS (SELECT 1 FROM r WHERE r.cat = x.category AND r.prefix = pre AND num BETWEEN r.lo AND r.hi) AS in_range,
  CASE WHEN bike AND pre <> '거' THEN 1 WHEN foot AND NOT bike AND pre <> '보' THEN 2 WHEN NOT bike AND NOT foot AND pre <> '' THEN 3
       WHEN NOT bike AND NOT foot AND lot AND NOT (pre = '' AND num BETWEEN 601 AND 626) THEN 4 END AS broken_rule
FROM x"""


@register("accident_rules", _ACCIDENT_RULES_SQL)
def accident_rules(spark, sf_dir):
    """L3-L5 with the rule tables themselves: party type, sub-type, permitted ids and prohibitions."""
    d = accidents(spark, sf_dir)
    c = rul.subclassify(rul.classify(d, "body"), "body", "category")
    pre, num = rul.split_diagram_id("diagram_id")
    ok, _ = rul.range_check(F.col("category"), pre, num, rul.category_ranges())
    return c.select("doc_id", "category", "matched_keyword", "subcategory", rul.id_range_text("subcategory").alias("id_range"),
                    "diagram_id", ok.alias("in_range"), rul.broken_rule(F.col("body"), "diagram_id").alias("broken_rule"))


def accidents(spark, sf_dir):
    """An accident before each document's text, by its source, and a diagram id by its language."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source")
    which = F.substring("source", 4, 9).cast("int") % len(ACCIDENTS) + 1
    return d.select("doc_id", F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ACCIDENTS]), which), F.coalesce("text", F.lit(""))).alias("body"),
                 F.when(F.col("lang") == "en", "101").when(F.col("lang") == "fr", "거3").when(F.col("lang") == "de", "보2").otherwise("610").alias("diagram_id"))


def rule_rows(spark):
    """The fixed keyword tables as one rule table: party types without a scope, sub-types under their party type."""
    tables = [(None, rul.CATEGORY_RULES), *[(c, r) for c, (r, _) in rul.SUBCATEGORY_RULES.items()]]
    rows = [(c, r.label, r.level, w) for c, rules in tables for r in rules for w in r.keywords]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "scope string, label string, level int, keyword string, position int")


@register("accident_rules_table", _ACCIDENT_RULES_SQL)
def accident_rules_table(spark, sf_dir):
    """L3-L5, J7, J8 as joins: the keywords and the permitted ranges come from tables; each text is read once for all of them."""
    hit = tbl.with_keyword_hits(accidents(spark, sf_dir), "doc_id", "body", rule_rows(spark))
    first = tbl.winner("hits")
    c = hit.select("doc_id", "body", "diagram_id", "hits", F.coalesce(first["label"], F.lit(rul.CATEGORY_DEFAULT)).alias("category"), first["keyword"].alias("matched_keyword"))
    defaults = spark.createDataFrame([(k, d) for k, (_, d) in rul.SUBCATEGORY_RULES.items()], "category string, fallback string")
    ranges = spark.createDataFrame([(sub, *r) for sub, r in rul.ID_RANGES.items()], "subcategory string, prefix string, lo int, hi int")
    permitted = spark.createDataFrame(rul.category_ranges(), "category string, prefix string, lo int, hi int")
    c = c.join(defaults, "category", "left").withColumn("subcategory", F.coalesce(tbl.winner("hits", "category")["label"], F.col("fallback")))
    pre, num = rul.split_diagram_id("diagram_id")
    c = tbl.range_check_table(c, "category", pre, num, permitted).join(ranges, "subcategory", "left")
    named = F.concat(F.col("prefix"), F.col("lo").cast("string"), F.lit("~"), F.col("prefix"), F.col("hi").cast("string"))
    return c.select("doc_id", "category", "matched_keyword", "subcategory", named.alias("id_range"), "diagram_id", "in_range",
                    rul.broken_rule(F.col("body"), "diagram_id").alias("broken_rule"))


# Rules and texts in numbers: a keyword for every pair of brand and kind and every kind with a size; an order's text names its parts.
@register("keyword_rules_many", """
WITH r AS (
  SELECT DISTINCT p_brand || ' ' || p_type AS keyword, p_brand AS label, 2 AS level FROM part
  UNION ALL SELECT DISTINCT p_type || ' ' || CAST(p_size AS VARCHAR), p_type, 1 + p_size % 3 FROM part
  UNION ALL SELECT DISTINCT p_name, 'named', 3 FROM part
),
n AS (SELECT *, row_number() OVER (ORDER BY keyword, label, level) AS position FROM r),
t AS (SELECT l_orderkey, string_agg(p_name || ', ' || p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS body
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
h AS (SELECT l_orderkey, label, keyword, count(*) OVER (PARTITION BY l_orderkey) AS n_hits,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY level, length(keyword) DESC, position) AS rn FROM t JOIN n ON contains(body, keyword))
SELECT t.l_orderkey, coalesce(label, 'none') AS label, keyword AS matched_keyword, coalesce(n_hits, 0) AS n_hits FROM t LEFT JOIN h ON h.l_orderkey = t.l_orderkey AND rn = 1""")
def keyword_rules_many(spark, sf_dir):
    """J8 with some hundred keywords from a table: the winner and the number of keywords in each text."""
    t = Tables(spark, sf_dir)
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rules = (p.select(F.concat_ws(" ", "p_brand", "p_type").alias("keyword"), F.col("p_brand").alias("label"), F.lit(2).alias("level")).distinct()
             .unionByName(p.select(F.concat_ws(" ", "p_type", s(F.col("p_size"))).alias("keyword"), F.col("p_type").alias("label"), (1 + F.col("p_size") % 3).alias("level")).distinct())
             .unionByName(p.select(F.col("p_name").alias("keyword"), F.lit("named").alias("label"), F.lit(3).alias("level")).distinct()))
    rules = rules.withColumn("position", F.struct("keyword", "label", "level"))  # the table's order, by its values
    names = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(" "), s(F.col("p_size")))
    texts = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", names.alias("name")))), lambda x: x["name"]), "; ").alias("body"))
    hit = tbl.with_keyword_hits(texts, "l_orderkey", "body", rules)
    first = tbl.winner("hits")
    return hit.select("l_orderkey", F.coalesce(first["label"], F.lit("none")).alias("label"), first["keyword"].alias("matched_keyword"), F.size("hits").cast("long").alias("n_hits"))


# A range for every order (by its customer, of widths from one to thousands), a number for every line.
@register("range_rules_table", """
WITH r AS (SELECT o_orderkey AS rule_id, o_orderpriority AS category, CASE WHEN o_orderkey % 3 = 0 THEN '보' ELSE '' END AS prefix, o_custkey AS lo,
                  o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 4096 WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 9 END AS hi FROM orders),
p AS (SELECT DISTINCT o_orderpriority AS category, CASE WHEN l_linenumber = 1 THEN '보' ELSE '' END AS prefix, l_partkey + l_suppkey AS number
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT category, prefix, number, count(rule_id) AS n_ranges, min(rule_id) AS first_rule, max(hi - lo) AS widest
FROM p LEFT JOIN r USING (category, prefix) WHERE number BETWEEN lo AND hi GROUP BY ALL""")
def range_rules_table(spark, sf_dir):
    """All numbers against as many ranges as there are orders; overlapping ranges all count."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    width = F.when(k % 50 == 0, k % 4096).when(k % 7 == 0, -1).otherwise(k % 9)
    ranges = o.select(k.alias("rule_id"), F.col("o_orderpriority").alias("category"), F.when(k % 3 == 0, "보").otherwise("").alias("prefix"),
                      F.col("o_custkey").alias("lo"), (F.col("o_custkey") + width).alias("hi"))
    points = t.lineitem.join(o, F.col("l_orderkey") == k).select(
        F.col("o_orderpriority").alias("category"), F.when(F.col("l_linenumber") == 1, "보").otherwise("").alias("prefix"), (F.col("l_partkey") + F.col("l_suppkey")).alias("number")).distinct()
    met = tbl.matching_ranges(points, ranges, ["category", "prefix"], "number")
    return met.groupBy("category", "prefix", "number").agg(F.count(F.lit(1)).alias("n_ranges"), F.min("rule_id").alias("first_rule"), F.max(F.col("hi") - F.col("lo")).alias("widest"))


# ---------------------------------------------------------- diagram ids/titles

PART_RANGES = [("ECONOMY", "", 1, 20), ("SMALL", "", 5, 30), ("SMALL", "", 40, 50), ("LARGE", "", 10, 50),
               ("PROMO", "", 1, 10), ("PROMO", "", 5, 25), ("MEDIUM", "", 20, 40)]


@register("diagram_range_check", """
WITH d AS (
  SELECT p_partkey, p_type,
         CASE WHEN p_brand = 'Brand#1' THEN '보' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS diagram_id
  FROM part
),
x AS (
  SELECT *, regexp_extract(diagram_id, '^(\\D*)(\\d+)$', 1) AS pre,
         TRY_CAST(regexp_extract(diagram_id, '^(\\D*)(\\d+)$', 2) AS INTEGER) AS num FROM d
),
y AS (
  SELECT *, coalesce(
    (p_type = 'ECONOMY' AND pre = '' AND num BETWEEN 1 AND 20) OR
    (p_type = 'SMALL' AND pre = '' AND (num BETWEEN 5 AND 30 OR num BETWEEN 40 AND 50)) OR
    (p_type = 'LARGE' AND pre = '' AND num BETWEEN 10 AND 50) OR
    (p_type = 'PROMO' AND pre = '' AND (num BETWEEN 1 AND 10 OR num BETWEEN 5 AND 25)) OR
    (p_type = 'MEDIUM' AND pre = '' AND num BETWEEN 20 AND 40), false) AS in_range
  FROM x
)
SELECT p_partkey, p_type, diagram_id, in_range,
  CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE', 'PROMO', 'MEDIUM') THEN 'no_rule'
       WHEN num IS NULL THEN 'bad_id' WHEN NOT in_range THEN 'out_of_range' END AS reason
FROM y""")
def diagram_range_check(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_type", "p_size")
    did = F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("보"), s(F.col("p_size")))).otherwise(s(F.col("p_size")))
    d = p.select("p_partkey", "p_type", did.alias("diagram_id"))
    pre, num = rul.split_diagram_id("diagram_id")
    ok, reason = rul.range_check(F.col("p_type"), pre, num, PART_RANGES)
    return d.select("p_partkey", "p_type", "diagram_id", ok.alias("in_range"), reason.alias("reason"))


def titles(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_type", "p_size")
    base = F.concat(F.lit(" (A"), s(F.col("p_size")), F.lit(":B"), s(F.lit(100) - F.col("p_size")), F.lit(")"))
    title = F.concat(s(F.col("p_partkey")), F.lit(": "), F.col("p_brand"), F.lit(" vs "), F.col("p_type"),
                     F.when(F.col("p_size") <= 45, base).otherwise(F.lit("")))
    return p.select("p_partkey", "p_brand", "p_type", "p_size", title.alias("title"))


_TITLES_SQL = """
t AS (
  SELECT p_partkey, p_brand, p_type, p_size,
         CAST(p_partkey AS VARCHAR) || ': ' || p_brand || ' vs ' || p_type
         || CASE WHEN p_size <= 45 THEN ' (A' || CAST(p_size AS VARCHAR) || ':B' || CAST(100 - p_size AS VARCHAR) || ')' ELSE '' END AS title
  FROM part
),
parsed AS (
  SELECT *,
    nullif(regexp_extract(title, '^\\s*([^:]+?)\\s*:', 1), '') AS diagram_id,
    nullif(regexp_extract(title, '^(?:[^:]*:\\s*)?(.+?) vs (.+?)(?:\\s*\\(A\\d+:B\\d+\\))?\\s*$', 1), '') AS label_a,
    nullif(regexp_extract(title, '^(?:[^:]*:\\s*)?(.+?) vs (.+?)(?:\\s*\\(A\\d+:B\\d+\\))?\\s*$', 2), '') AS label_b,
    TRY_CAST(nullif(regexp_extract(title, 'A(\\d+):B(\\d+)', 1), '') AS INTEGER) AS base_fault_a,
    TRY_CAST(nullif(regexp_extract(title, 'A(\\d+):B(\\d+)', 2), '') AS INTEGER) AS base_fault_b
  FROM t
)"""


@register("diagram_title_parse", f"""WITH {_TITLES_SQL}
SELECT p_partkey, title, diagram_id, label_a, label_b, base_fault_a, base_fault_b FROM parsed""")
def diagram_title_parse(spark, sf_dir):
    t = titles(spark, sf_dir)
    parts = rul.parse_title("title")
    return t.select("p_partkey", "title", *[v.alias(k) for k, v in parts.items()])


@register("party_alignment", f"""WITH {_TITLES_SQL},
u AS (
  SELECT *, CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS user_a_label,
            CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS user_b_label,
            p_size AS user_fault_a, 100 - p_size AS user_fault_b
  FROM parsed
),
v AS (SELECT *, coalesce(user_a_label = label_b OR user_b_label = label_a, false) AS swapped FROM u)
SELECT p_partkey, label_a, label_b, user_a_label, swapped,
       CASE WHEN swapped THEN 'B' ELSE 'A' END AS user_a_side,
       CASE WHEN swapped THEN user_fault_b ELSE user_fault_a END AS fault_a,
       CASE WHEN swapped THEN user_fault_a ELSE user_fault_b END AS fault_b
FROM v""")
def party_alignment(spark, sf_dir):
    t = titles(spark, sf_dir)
    parts = rul.parse_title("title")
    t = t.select("p_partkey", "p_brand", "p_type", "p_size", parts["label_a"].alias("label_a"),
                 parts["label_b"].alias("label_b"))
    ua = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))
    ub = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_type"))
    t = t.withColumn("user_a_label", ua).withColumn("user_b_label", ub)
    al = rul.align_parties(F.col("user_a_label"), F.col("user_b_label"), F.col("label_a"), F.col("label_b"),
                           F.col("p_size"), F.lit(100) - F.col("p_size"))
    return t.select("p_partkey", "label_a", "label_b", "user_a_label", al["swapped"].alias("swapped"),
                    al["user_a_side"].alias("user_a_side"), al["fault_a"].alias("fault_a"),
                    al["fault_b"].alias("fault_b"))


# ----------------------------------------------------------------- modifiers

@register("apply_modifiers", """
SELECT l_orderkey,
  CAST(greatest(0, least(100, 50 + coalesce(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) - 25 END), 0))) AS BIGINT) AS fault_a,
  CAST(greatest(0, least(100, 50 + coalesce(sum(CASE WHEN l_linestatus <> 'O' THEN CAST(l_quantity AS BIGINT) - 25 END), 0))) AS BIGINT) AS fault_b,
  count(*) AS n_modifiers
FROM lineitem GROUP BY l_orderkey""")
def apply_modifiers(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linestatus", "l_quantity")
    mods = li.select("l_orderkey",
                     F.when(F.col("l_linestatus") == "O", F.lit("A")).otherwise(F.lit("B")).alias("target"),
                     (F.col("l_quantity").cast("bigint") - 25).alias("value"))
    return rul.apply_modifier_rows(mods, "l_orderkey", 50, 50, "target", "value")


# ------------------------------------------------------------------ rendering

# Two catalogue lines in the title format of the prompt.
CATALOGUE = "101: 녹색직진 vs 적색직진\n106: 직진 vs 비보호좌회전 (A30:B70)"


def _sql_lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@register("render_prompt", f"""
SELECT doc_id, {_sql_lit(rnd.PROMPT_HEAD)} || coalesce(text, 'null') || {_sql_lit(rnd.PROMPT_LIST)}
       || {_sql_lit(CATALOGUE)} AS prompt FROM documents""")
def render_prompt(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return d.select("doc_id", rnd.render_prompt("text", CATALOGUE).alias("prompt"))


def report_rows(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    detail_t = "array<struct<name:string,target:string,value:int,reason:string>>"
    return p.select(
        "p_partkey",
        F.col("p_type").alias("category"),
        F.concat(F.col("p_brand"), F.lit(" vs "), F.col("p_type")).alias("diagram_title"),
        s(F.col("p_partkey")).alias("diagram_id"),
        F.col("p_brand").alias("label_a"), F.col("p_type").alias("label_b"),
        size.alias("base_fault_a"), (F.lit(100) - size).alias("base_fault_b"),
        F.least(F.lit(100), size + 10).alias("fault_a"), (F.lit(100) - F.least(F.lit(100), size + 10)).alias("fault_b"),
        F.when(size % 3 == 0, F.lit(None).cast("array<string>"))
         .when(size % 3 == 1, F.array().cast("array<string>"))
         .otherwise(F.split("p_name", " ")).alias("modifiers"),
        F.when(size % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.array("p_type")).alias("detected_modifiers"),
        F.when(size % 4 == 0, F.lit(None).cast(detail_t)).otherwise(
            F.array(F.struct(F.col("p_type").alias("name"), F.lit("A").alias("target"),
                             (size % 10).alias("value"), F.col("p_brand").alias("reason")))).alias("modifier_detail"),
        F.when(size > 40, F.array(F.concat(F.lit("case-"), s(F.col("p_partkey"))))).alias("precedent_refs"),
        F.col("p_name").alias("input_text"),
    )


_JOIN_NONE = "coalesce(nullif(array_to_string(coalesce({a}, CAST([] AS VARCHAR[])), ', '), ''), '없음')"


@register("render_report", f"""
WITH r AS (
  SELECT p_partkey, p_type AS category, p_brand || ' vs ' || p_type AS diagram_title,
    CAST(p_partkey AS VARCHAR) AS diagram_id, p_brand AS label_a, p_type AS label_b,
    p_size AS base_fault_a, 100 - p_size AS base_fault_b,
    least(100, p_size + 10) AS fault_a, 100 - least(100, p_size + 10) AS fault_b,
    CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END AS modifiers,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE [p_type] END AS detected_modifiers,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE [{{'name': p_type, 'target': 'A', 'value': CAST(p_size % 10 AS INTEGER), 'reason': p_brand}}] END AS modifier_detail,
    CASE WHEN p_size > 40 THEN ['case-' || CAST(p_partkey AS VARCHAR)] END AS precedent_refs,
    p_name AS input_text
  FROM part
)
SELECT p_partkey,
  {_sql_lit(rnd.REPORT_HEAD)}
  || '사고 유형: ' || category || ' — ' || diagram_title || chr(10)
  || '적용 도표: ' || diagram_id || chr(10) || chr(10)
  || '기본 과실비율: ' || label_a || ' ' || CAST(base_fault_a AS VARCHAR) || '% : ' || label_b || ' ' || CAST(base_fault_b AS VARCHAR) || '%' || chr(10)
  || '수정요소: ' || {_JOIN_NONE.format(a="coalesce(modifiers, detected_modifiers)")} || chr(10)
  || '수정요소 상세: ' || coalesce(CAST(to_json(modifier_detail) AS VARCHAR), '[]') || chr(10)
  || '최종 과실비율: ' || label_a || ' ' || CAST(fault_a AS VARCHAR) || '% : ' || label_b || ' ' || CAST(fault_b AS VARCHAR) || '%' || chr(10)
  || '유사 판례: ' || {_JOIN_NONE.format(a="precedent_refs")} || chr(10)
  || '사고 상황: ' || input_text
  || {_sql_lit(rnd.REPORT_TAIL)} AS report
FROM r""")
def render_report(spark, sf_dir):
    r = report_rows(spark, sf_dir)
    c = F.col
    return r.select("p_partkey", rnd.render_report(
        c("category"), c("diagram_title"), c("diagram_id"), c("label_a"), c("label_b"), c("base_fault_a"),
        c("base_fault_b"), c("fault_a"), c("fault_b"), c("modifiers"), c("detected_modifiers"),
        c("modifier_detail"), c("precedent_refs"), c("input_text")).alias("report"))


# ---------------------------------------------------------------------- usage

MODEL = "default-model"

_LEDGER_SQL = f"""
calls AS (
  SELECT conv_id,
    CAST(sum(length(text)) FILTER (WHERE role IN ('user', 'system')) AS BIGINT) AS input_tokens,
    CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT) AS output_tokens,
    CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'report' ELSE 'match' END AS purpose
  FROM conversations GROUP BY conv_id
),
ledger AS (
  SELECT conv_id, '{MODEL}' AS model, purpose, input_tokens, output_tokens,
    coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total_tokens,
    TRY_CAST((CAST(coalesce(input_tokens, 0) AS DECIMAL(20,0)) * 0.003
              + CAST(coalesce(output_tokens, 0) AS DECIMAL(20,0)) * 0.015) * 0.001 AS DECIMAL(8,6)) AS cost_usd
  FROM calls
)"""


def _ledger(spark, sf_dir, report_scale: int = 1, by_day: bool = False):
    c = Tables(spark, sf_dir).conversations.select("conv_id", "role", "text")
    n = F.length("text").cast("bigint")
    report = F.count_if(F.col("role") == "system") > 0
    calls = c.groupBy("conv_id").agg(
        F.date_add(F.lit("2024-01-01").cast("date"), F.count(F.lit(1)).cast("int")).alias("day"),
        (F.sum(F.when(F.col("role").isin("user", "system"), n)) * F.when(report, report_scale).otherwise(1)).alias("input_tokens"),
        F.sum(F.when(F.col("role") == "assistant", n)).alias("output_tokens"),
        F.when(report, F.lit("report")).otherwise(F.lit("analyze")).alias("mode"))
    led = use.ledger(calls.withColumn("model", F.lit(MODEL)), "input_tokens", "output_tokens", mode="mode")
    return led.select(*["day"] * by_day, "conv_id", "model", "purpose", "input_tokens", "output_tokens", "total_tokens",
                      "cost_usd", "cost_rejected")


@register("llm_cost_ledger", f"""WITH {_LEDGER_SQL}
SELECT *, cost_usd IS NULL AS cost_rejected FROM ledger""")
def llm_cost_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)


# Reports are scaled up until some of them cost more than the column holds.
_SCALED_SQL = _LEDGER_SQL.replace("SELECT conv_id,\n    CAST(sum(length(text)) FILTER (WHERE role IN ('user', 'system')) AS BIGINT)",
                                  "SELECT conv_id, count(*) AS n_turns,\n    CAST(sum(length(text)) FILTER (WHERE role IN ('user', 'system')) AS BIGINT)"
                                  " * CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 100000 ELSE 1 END") \
    .replace("SELECT conv_id, '", "SELECT DATE '2024-01-01' + CAST(n_turns AS INTEGER) AS day, conv_id, '")


@register("llm_cost_summary", f"""WITH {_SCALED_SQL}
SELECT day, model, purpose, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE cost_usd IS NULL) AS rejected_calls,
       CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd
FROM ledger GROUP BY day, model, purpose""")
def llm_cost_summary(spark, sf_dir):
    """A16 by day, model and purpose; a conversation's day follows from its number of turns."""
    return use.cost_summary(_ledger(spark, sf_dir, report_scale=100000, by_day=True), ["day", "model", "purpose"])
