"""The queries of the training-data operators over the given tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, decontam, exact_dedup, hard_negatives, langid, line_dedup, near_dedup, quotes, runs, sharding, substring_dedup, token_counts,
               url_filter)
from .shared import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@register("op1_quote_linking", r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
lv AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(l, '^([ \t]*>)+'), '[ \t]', '', 'g')) AS level,
              regexp_replace(l, '^([ \t]*>)+', '') AS body FROM raw),
mk AS (SELECT *, trim(regexp_replace(body, '[ \t\r\f]+', ' ', 'g')) = '' AS blank,
              level = 0 AND regexp_matches(body, '(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')
              AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) > 0, FALSE) AS names FROM lv),
st AS (SELECT *, NOT blank AND NOT names AND (i = 1 OR lag(blank OR names) OVER w OR lag(level) OVER w <> level) AS starts
       FROM mk WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
pa AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS passage FROM st),
ln AS (SELECT conv_id, turn, passage, level, i, body, count(*) OVER (PARTITION BY conv_id, turn, passage) AS n,
              row_number() OVER (PARTITION BY conv_id, turn, passage ORDER BY i) - 1 AS line FROM pa WHERE NOT blank AND NOT names),
un AS (SELECT conv_id, turn, passage, level, -1 AS line, string_agg(body, ' ' ORDER BY i) AS words FROM ln GROUP BY ALL
       UNION ALL SELECT conv_id, turn, passage, level, line, body FROM ln WHERE n > 1),
nu AS (SELECT conv_id, turn, passage, level, line, trim(regexp_replace(lower(words), '[ \t\r\n\f]+', ' ', 'g')) AS words FROM un),
own AS (SELECT conv_id, words, min(turn) AS origin FROM nu WHERE level = 0 GROUP BY ALL),
hit AS (SELECT q.*, CASE WHEN own.origin < q.turn THEN own.origin END AS origin FROM nu q LEFT JOIN own USING (conv_id, words) WHERE q.level > 0),
lk AS (SELECT conv_id, turn, passage, level, arg_min(origin, line) AS origin FROM hit GROUP BY ALL),
pr AS (SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked,
              min(CASE WHEN origin IS NOT NULL THEN {'l': level, 'p': passage, 'o': origin} END).o AS parent FROM lk GROUP BY ALL),
up AS (SELECT conv_id, turn, parent, parent AS root, 1 AS depth FROM pr WHERE parent IS NOT NULL
       UNION ALL SELECT up.conv_id, up.turn, up.parent, pr.parent, depth + 1 FROM up JOIN pr ON pr.conv_id = up.conv_id AND pr.turn = up.root WHERE pr.parent IS NOT NULL),
rt AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY ALL),
bd AS (SELECT conv_id, turn, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY i), '^([ \t\r\f]*\n)+', ''), '(\n[ \t\r\f]*)+$', '') AS body
       FROM mk WHERE level = 0 AND NOT names GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(bd.body, '') AS body, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
       pr.parent AS parent_turn, coalesce(rt.root, m.turn) AS thread_turn, coalesce(rt.depth, 0)::BIGINT AS depth
FROM m LEFT JOIN bd USING (conv_id, turn) LEFT JOIN pr USING (conv_id, turn) LEFT JOIN rt USING (conv_id, turn)
""")
def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of ``conversations`` without quotes, linked and in reply order."""
    out = quotes.reply_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "body", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth")


def held_out(doc_id) -> Column:
    """Documents that language ID never learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(~held_out(F.col("doc_id"))))


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.with_language(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                      F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"))


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text encoded and decoded, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.with_digests(out).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that nearly repeat an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@register("op6_decontamination", r"""
WITH it AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS phrase
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, text, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
          FROM (SELECT d.*, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT DISTINCT doc_id, text, item, s, k FROM grams JOIN win USING (k, phrase)),
pos AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(s, s + k)) AS p FROM hit) GROUP BY ALL),
its AS (SELECT doc_id, text, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, text, item FROM hit) GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id IS NOT DISTINCT FROM pos.doc_id AND d.text = pos.text
       LEFT JOIN its ON d.doc_id IS NOT DISTINCT FROM its.doc_id AND d.text = its.text
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of ten words of ``benchmark``."""
    index = decontam.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontam.find_phrases(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return decontam.judge_documents(index, written(found, "matches")).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near equal bytes."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


#: The list of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@register("op8_url_filter", r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
             row_number() OVER () AS r FROM pages),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``: the longest listed prefix, else not listed."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


@register("op9_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, w.doc_id IS NOT DISTINCT FROM coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
""")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its component of near copies."""
    out = near_dedup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op10_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM d JOIN g USING (text)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_copies(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op12_hard_negatives", """
WITH v AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``, with noise in the labels of every seventh."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = rows.select(F.col("vec_id").alias("id"), label.cast("int").alias("label"), vec.alias("vec"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document; the contract makes the words of some documents periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))  # a null doc_id leaves the text as it is
    docs = docs.withColumn("text", F.when(h % 10 == 0, _made_periodic(F.col("text"), F.floor(h / 10))).otherwise(F.col("text")))
    r = F.col("periodic.runs")
    longest = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    lines = F.transform(r, lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]))
    out = runs.with_runs(docs).select("doc_id", F.col("periodic.n_words").alias("n_words"), F.size(r).cast("long").alias("n_runs"), longest.alias("longest"),
                                      lines.alias("lines"), F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_words", "n_runs", (-F.col("longest.s")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.p")).alias("period"),
                      F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
                      F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), "collapsed_sha256")


def _made_periodic(text: Column, g: Column) -> Column:
    """The text whose words from number g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")).otherwise("")

    # an array of one, so that the words are split once
    return F.element_at(F.transform(F.array(words), repeated), 1)


@register("op11_substring_dedup")
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur again anywhere."""
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
