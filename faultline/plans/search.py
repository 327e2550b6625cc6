"""Search queries bound to the driver tables.

precedents = part: keywords = words of p_name (array; text search runs on
the joined string), categories = p_type, court = p_brand, fault_a = p_size,
relevance = p_retailprice. precedent_cases = orders (dated).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as srch
from ..session import scratch_path
from ..sources.tables import Tables
from .registry import register


def precedents(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    kw = F.split(F.col("p_name"), " ")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("case-"), F.col("p_partkey").cast("string")).alias("case_number"),
        F.col("p_name").alias("case_name"),
        F.col("p_brand").alias("court"),
        F.concat(F.col("p_size").cast("string"), F.lit(":"),
                 (F.lit(100) - F.col("p_size")).cast("string")).alias("fault_ratio"),
        F.col("p_size").alias("fault_a"),
        (F.lit(100) - F.col("p_size")).alias("fault_b"),
        F.col("p_type").alias("categories"),
        kw.alias("keywords"),
        F.array_join(kw, " ").alias("keywords_text"),
        F.col("p_retailprice").alias("relevance_score"),
    )


PRECEDENTS_SQL = """
precedents AS (
  SELECT p_partkey AS id, 'case-' || CAST(p_partkey AS VARCHAR) AS case_number, p_name AS case_name,
         p_brand AS court, CAST(p_size AS VARCHAR) || ':' || CAST(100 - p_size AS VARCHAR) AS fault_ratio,
         p_size AS fault_a, 100 - p_size AS fault_b, p_type AS categories,
         string_split(p_name, ' ') AS keywords, array_to_string(string_split(p_name, ' '), ' ') AS keywords_text,
         p_retailprice AS relevance_score
  FROM part
)"""

OUT = ["id", "case_number", "case_name", "court", "fault_ratio", "fault_a", "fault_b",
       "categories", "keywords_text", "relevance_score"]
OUT_SQL = ", ".join(OUT)


@register("precedent_search", f"""WITH {PRECEDENTS_SQL}
SELECT {OUT_SQL} FROM precedents
WHERE fault_ratio IS NOT NULL
  AND (keywords_text ILIKE '%blue%' OR keywords_text ILIKE '%ring%')
  AND court ILIKE '%Brand#1%' AND fault_a >= 10 AND fault_a <= 40
ORDER BY relevance_score DESC NULLS FIRST, id ASC LIMIT 20""")
def precedent_search(spark, sf_dir):
    req = srch.SearchRequest(keywords="blue, ring", court="Brand#1", fault_min="10",
                             fault_max="40", limit="20")
    return srch.search(precedents(spark, sf_dir), req).select(*OUT)


# Literal requests: two words; only a one-letter word (no keyword predicate);
# a word + category + open upper bound; an ideographic-space separator with
# a limit above the cap.
BATCH_REQUESTS = {
    1: srch.SearchRequest(keywords="blue ring"),
    2: srch.SearchRequest(keywords="a", limit="5"),
    3: srch.SearchRequest(keywords="gear", categories="promo", fault_min="30", limit="0"),
    4: srch.SearchRequest(keywords="hot　rod", court="Brand#2", limit="99"),
}


@register("precedent_search_batch", f"""WITH {PRECEDENTS_SQL},
req(request_id, keywords, categories, court, fault_min, fault_max, lim) AS (
  VALUES (1, 'blue ring', NULL, NULL, NULL, NULL, 10),
         (2, 'a', NULL, NULL, NULL, NULL, 5),
         (3, 'gear', 'promo', NULL, 30, NULL, 10),
         (4, 'hot' || chr(12288) || 'rod', NULL, 'Brand#2', NULL, NULL, 50)
),
r AS (
  SELECT *, list_filter(regexp_split_to_array(keywords, '[\\s\\p{{Z}},]+'), lambda w: length(w) > 1) AS words
  FROM req
),
m AS (
  SELECT r.request_id, r.lim, p.*
  FROM r JOIN precedents p
    ON (len(r.words) = 0 OR list_bool_or(list_transform(r.words, lambda w: p.keywords_text ILIKE '%' || w || '%')))
   AND (r.categories IS NULL OR p.categories ILIKE '%' || r.categories || '%')
   AND (r.court IS NULL OR p.court ILIKE '%' || r.court || '%')
   AND (r.fault_min IS NULL OR p.fault_a >= r.fault_min)
   AND (r.fault_max IS NULL OR p.fault_a <= r.fault_max)
  WHERE p.fault_ratio IS NOT NULL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance_score DESC NULLS FIRST, id) AS rank
  FROM m
)
SELECT request_id, rank, {OUT_SQL} FROM ranked WHERE rank <= lim""")
def precedent_search_batch(spark, sf_dir):
    out = srch.search_batch(precedents(spark, sf_dir), BATCH_REQUESTS)
    return out.select(F.col("request_id").cast("int").alias("request_id"),
                      F.col("rank").cast("bigint").alias("rank"), *OUT)


# One request per nation: words by region, the court by nation, a lower bound and a limit.
_REGION_WORDS = ["blue ring", "hot, rod", "a", "gear", "green　lime"]


@register("precedent_search_table", f"""WITH {PRECEDENTS_SQL},
r AS (
  SELECT n_nationkey AS request_id, list_extract([{", ".join(f"'{w}'" for w in _REGION_WORDS)}], CAST(n_regionkey AS INTEGER) + 1) AS keywords,
         'brand#' || CAST(n_nationkey % 5 + 1 AS VARCHAR) AS court, n_nationkey AS fault_min, 1 + n_nationkey % 7 AS lim FROM nation
),
w AS (SELECT *, list_filter(regexp_split_to_array(keywords, '[\\s\\p{{Z}},]+'), lambda x: length(x) > 1) AS words FROM r),
m AS (
  SELECT w.request_id, w.lim, p.* FROM w JOIN precedents p
    ON (len(w.words) = 0 OR list_bool_or(list_transform(w.words, lambda x: p.keywords_text ILIKE '%' || x || '%')))
   AND p.court ILIKE '%' || w.court || '%' AND (w.fault_min = 0 OR p.fault_a >= w.fault_min)
  WHERE p.fault_ratio IS NOT NULL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance_score DESC NULLS FIRST, id) AS rank FROM m)
SELECT CAST(request_id AS BIGINT) AS request_id, rank, {OUT_SQL} FROM ranked WHERE rank <= lim""")
def precedent_search_table(spark, sf_dir):
    """The requests are rows of a table (here derived from nation)."""
    n = Tables(spark, sf_dir).nation
    words = F.element_at(F.array(*[F.lit(w) for w in _REGION_WORDS]), F.col("n_regionkey").cast("int") + 1)
    reqs = n.select(F.col("n_nationkey").cast("long").alias("request_id"), words.alias("keywords"),
                    F.concat(F.lit("brand#"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("court"),
                    F.col("n_nationkey").cast("int").alias("fault_min"), (1 + F.col("n_nationkey") % 7).cast("int").alias("limit"))
    out = srch.search_table(precedents(spark, sf_dir), reqs)
    return out.select(F.col("request_id").cast("bigint").alias("request_id"), F.col("rank").cast("bigint").alias("rank"), *OUT)


# One request per part: a piece of its name or two words (one of them a wildcard word for some), a piece of its
# kind, its brand, bounds around its size; every kind of request comes many times.
@register("precedent_search_requests", f"""WITH {PRECEDENTS_SQL},
r AS (
  SELECT p_partkey AS request_id,
         CASE p_partkey % 6 WHEN 0 THEN substr(p_name, 2, 5) WHEN 1 THEN p_name WHEN 2 THEN substr(p_name, 1, 2) || ', zz'
                            WHEN 3 THEN 'r_n' WHEN 4 THEN '%%' || ' ' || substr(p_name, 1, 3) ELSE '' END AS keywords,
         CASE WHEN p_partkey % 4 = 1 THEN lower(substr(p_type, 2, 3)) WHEN p_partkey % 4 = 2 THEN '' END AS categories,
         CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS court,
         CASE WHEN p_partkey % 5 < 3 THEN p_size - 5 END AS fault_min, CASE WHEN p_partkey % 7 < 4 THEN CAST(p_size + 3 AS VARCHAR) END AS fault_max,
         1 + p_partkey % 12 AS lim FROM part
),
w AS (SELECT *, list_filter(regexp_split_to_array(keywords, '[\\s\\p{{Z}},]+'), lambda x: length(x) > 1) AS words FROM r),
m AS (
  SELECT w.request_id, w.lim, p.* FROM w JOIN precedents p
    ON (len(w.words) = 0 OR list_bool_or(list_transform(w.words, lambda x: p.keywords_text ILIKE '%' || x || '%')))
   AND (coalesce(w.categories, '') = '' OR p.categories ILIKE '%' || w.categories || '%') AND (w.court IS NULL OR p.court ILIKE '%' || w.court || '%')
   AND (coalesce(w.fault_min, 0) = 0 OR p.fault_a >= w.fault_min) AND (w.fault_max IS NULL OR p.fault_a <= CAST(w.fault_max AS INTEGER))
  WHERE p.fault_ratio IS NOT NULL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY relevance_score DESC NULLS FIRST, id) AS rank FROM m)
SELECT request_id, rank, {OUT_SQL} FROM ranked WHERE rank <= lim""")
def precedent_search_requests(spark, sf_dir):
    """As many requests as there are parts, joined to the precedents by the gram index."""
    p, k = Tables(spark, sf_dir).part, F.col("p_partkey")
    words = (F.when(k % 6 == 0, F.substring("p_name", 2, 5)).when(k % 6 == 1, F.col("p_name")).when(k % 6 == 2, F.concat(F.substring("p_name", 1, 2), F.lit(", zz")))
             .when(k % 6 == 3, "r_n").when(k % 6 == 4, F.concat(F.lit("%% "), F.substring("p_name", 1, 3))).otherwise(""))
    reqs = p.select(k.alias("request_id"), words.alias("keywords"),
                    F.when(k % 4 == 1, F.lower(F.substring("p_type", 2, 3))).when(k % 4 == 2, "").alias("categories"),
                    F.when(k % 3 == 0, F.col("p_brand")).alias("court"), F.when(k % 5 < 3, F.col("p_size") - 5).alias("fault_min"),
                    F.when(k % 7 < 4, (F.col("p_size") + 3).cast("string")).alias("fault_max"), (1 + k % 12).alias("limit"))
    out = srch.search_table(precedents(spark, sf_dir), reqs)
    return out.select("request_id", F.col("rank").cast("bigint").alias("rank"), *OUT)


@register("precedent_by_keyword", """
SELECT 'C' || CAST(o_orderkey AS VARCHAR) AS case_number, o_orderstatus AS court, o_orderdate AS date,
       o_orderpriority AS accident_type, o_custkey % 101 AS fault_ratio_a, 100 - o_custkey % 101 AS fault_ratio_b,
       o_orderkey
FROM orders WHERE o_orderpriority ILIKE '%urgent%'
ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC NULLS FIRST LIMIT 10""")
def precedent_by_keyword(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    cases = o.select(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("case_number"),
        F.col("o_orderstatus").alias("court"), F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("accident_type"),
        (F.col("o_custkey") % 101).alias("fault_ratio_a"),
        (F.lit(100) - F.col("o_custkey") % 101).alias("fault_ratio_b"), "o_orderkey")
    return srch.keyword_filter_latest(cases, "accident_type", "urgent", "date", "o_orderkey", n=10)


@register("keyword_array_match", """
SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), ' ') AS keywords_text FROM part
WHERE list_contains(string_split(p_name, ' '), 'ring') OR list_contains(string_split(p_name, ' '), 'hot')""")
def keyword_array_match(spark, sf_dir):
    p = precedents(spark, sf_dir).select("id", "keywords", "keywords_text")
    return srch.array_keyword_match(p, "keywords", ["ring", "hot"], mode="any").select("id", "keywords_text")


@register("keyword_index_match", """
SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), ' ') AS keywords_text FROM part
WHERE list_contains(string_split(p_name, ' '), 'ring') OR list_contains(string_split(p_name, ' '), 'hot')""")
def keyword_index_match(spark, sf_dir):
    """F12 through the stored keyword index: (keyword, id) rows sorted by keyword, a filter pushed into them, semi join back."""
    p = precedents(spark, sf_dir).select("id", "keywords", "keywords_text")
    index = srch.write_keyword_index(srch.keyword_index(p, "id", "keywords"), scratch_path(spark, "indexes", uuid.uuid4().hex), "id")
    ids = srch.index_lookup(index, ["ring", "hot"], "id")
    return p.join(ids, "id", "left_semi").select("id", "keywords_text")
