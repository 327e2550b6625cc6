"""Precedent search.

A single request is a chain of optional filters and an ordered limit, which
Catalyst turns into one scan + Filter + TakeOrderedAndProject.

A batch of requests is answered in ONE scan of the precedent table: every
row gets the ids of the requests it satisfies (one projected array, no join
and no row-pair blow-up), those ids are exploded, and the per-request top-k
is a ``row_number() <= k`` filter, which Spark plans as a partial
WindowGroupLimit before the shuffle -- so a request matching a third of the
table still ships at most k rows per map task.

A table of requests is joined to the precedents by an index of character
grams (``search_table``); nothing of it passes through the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ilike_contains, pattern_grams, search_words, split_words_py, text_grams
from ..session import scratch_path

DEFAULT_LIMIT = 10
MAX_LIMIT = 50


def _parse_int(v) -> int | None:
    """``parseInt`` of a request value: leading sign and digits, else None."""
    import re

    if v is None:
        return None
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return int(v)
    m = re.match(r"\s*([+-]?\d+)", str(v))
    return int(m.group(1)) if m else None


def resolve_limit(limit) -> int:
    """``min(parseInt(limit) || 10, 50)``, clamped below at 1."""
    n = _parse_int(limit)
    n = n if n else DEFAULT_LIMIT
    return max(1, min(n, MAX_LIMIT))


@dataclass
class SearchRequest:
    keywords: str | None = None
    categories: str | None = None
    court: str | None = None
    fault_min: str | int | None = None
    fault_max: str | int | None = None
    limit: str | int | None = None
    literal: bool = False

    def predicate(self, keywords_text: str, categories: str, court: str, fault: str) -> Column:
        """AND of the optional predicates (None parameter = no predicate)."""
        cond = F.lit(True)
        words = split_words_py(self.keywords)
        if words:  # no surviving word, no keyword predicate
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | ilike_contains(keywords_text, w, self.literal)
            cond = cond & any_word
        if self.categories:
            cond = cond & ilike_contains(categories, self.categories, self.literal)
        if self.court:
            cond = cond & ilike_contains(court, self.court, self.literal)
        lo, hi = _bound(self.fault_min), _bound(self.fault_max)
        if lo is not None:
            cond = cond & (F.col(fault) >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(fault) <= F.lit(hi))
        return cond


def _bound(v) -> int | None:
    """``if (fault_min)``: a falsy value (None, '', numeric 0) sets no bound;
    the string '0' is truthy, so it does. Unparsable text sets none."""
    if v is None or v == "" or isinstance(v, bool):
        return None
    if isinstance(v, (int, float)) and (v == 0 or v != v):
        return None
    return _parse_int(v)


def search(df: DataFrame, req: SearchRequest, keywords_text: str = "keywords_text",
           categories: str = "categories", court: str = "court", fault: str = "fault_a",
           relevance: str = "relevance_score", tiebreak: str = "id",
           required: str | None = "fault_ratio") -> DataFrame:
    """F3-F8 + O4: one search request, newest-relevance first, top ``limit``."""
    cond = req.predicate(keywords_text, categories, court, fault)
    if required:
        cond = F.col(required).isNotNull() & cond
    return (df.where(cond)
              .orderBy(F.desc_nulls_first(relevance), F.asc(tiebreak))
              .limit(resolve_limit(req.limit)))


def search_batch(df: DataFrame, requests: dict[int, SearchRequest], keywords_text: str = "keywords_text",
                 categories: str = "categories", court: str = "court", fault: str = "fault_a",
                 relevance: str = "relevance_score", tiebreak: str = "id",
                 required: str | None = "fault_ratio", request_col: str = "request_id",
                 rank_col: str = "rank") -> DataFrame:
    """Answer many requests in one scan; top-k per request.

    ``requests`` are request parameters (a bounded, driver-side mapping),
    compiled into one projected array of matching request ids per row.
    """
    hits = F.array_compact(F.array(*[
        F.when(r.predicate(keywords_text, categories, court, fault), F.lit(rid))
        for rid, r in requests.items()]))
    base = df.where(F.col(required).isNotNull()) if required else df
    matched = base.withColumn(request_col, F.explode(hits))
    limits = {rid: resolve_limit(r.limit) for rid, r in requests.items()}
    lim = F.lit(None).cast("int")
    for rid, n in limits.items():
        lim = F.when(F.col(request_col) == F.lit(rid), F.lit(n)).otherwise(lim)
    w = Window.partitionBy(request_col).orderBy(F.desc_nulls_first(relevance), F.asc(tiebreak))
    ranked = matched.withColumn(rank_col, F.row_number().over(w))
    return ranked.where((F.col(rank_col) <= F.lit(max(limits.values()))) & (F.col(rank_col) <= lim))


def limit_column(c: Column) -> Column:
    """``resolve_limit`` of a column, numeric or text."""
    n = F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)")
    n = F.when(n.isNull() | (n == 0), F.lit(DEFAULT_LIMIT)).otherwise(n)
    return F.least(F.greatest(n, F.lit(1)), F.lit(MAX_LIMIT)).cast("int")


def bound_column(c: Column, kind: str) -> Column:
    """``_bound`` of a column of the type ``kind``: a numeric 0 sets no bound, the text '0' does."""
    if kind in ("string", "void"):
        return F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.when(c != 0, c.try_cast("bigint"))


def search_table(df: DataFrame, requests: DataFrame, keywords_text: str = "keywords_text", categories: str = "categories",
                 court: str = "court", fault: str = "fault_a", relevance: str = "relevance_score", tiebreak: str = "id",
                 required: str | None = "fault_ratio", request_col: str = "request_id", rank_col: str = "rank", literal: bool = False) -> DataFrame:
    """W4 with the requests in a table: ``request_id`` (unique) and the request's parameters as columns.

    A join by a gram index, in one plan whatever the number of requests:

    1. A set of terms is one word of ``keywords`` (or none), a category and a court.
       Requests with the same words, category, court and bounds are one question, whose
       words each name a set.
    2. The distinct texts are exploded into (field, gram) postings, of the grams
       that some term holds. Each term is looked up by its rarest gram (three
       characters, or fewer in a shorter term); a set of terms by the field with
       the fewest postings. A set without such a field (no term, or wildcards only)
       meets every distinct text, dealt over ``ALL_BUCKETS`` keys.
    3. ``ILIKE`` decides on each distinct text met.
    4. As no request returns more rows than the largest limit asked, that many of each
       text and fault value are enough, then of each set and fault value, of each set
       and bounds, and of each question over its sets; the rows are carried as their
       relevance, tiebreak and number, and fetched in the end.

    Parameters that ``requests`` lacks are not used.
    """
    have = set(requests.columns)
    par = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    kind = lambda n: requests.schema[n].dataType.simpleString() if n in have else "void"
    filled = lambda n: F.nullif(par(n).cast("string"), F.lit(""))
    asked = requests.select(F.col(request_col), search_words(par("keywords").cast("string")).alias("_words"), filled("categories").alias("_category"),
                            filled("court").alias("_court"), bound_column(par("fault_min"), kind("fault_min")).alias("_lo"),
                            bound_column(par("fault_max"), kind("fault_max")).alias("_hi"), limit_column(par("limit")).alias("_limit"))
    asked = asked.withColumn("_words", F.array_sort(F.array_distinct("_words")))
    asked = asked.withColumn("_question", F.md5(F.to_json(F.struct("_words", "_category", "_court", "_lo", "_hi"))))
    questions = asked.groupBy("_question").agg(*[F.first(c).alias(c) for c in ("_words", "_category", "_court", "_lo", "_hi")], F.max("_limit").alias("_most"))
    questions = questions.withColumn("_word", F.explode_outer("_words")).drop("_words")
    questions = questions.withColumn("_terms", F.md5(F.to_json(F.struct("_word", "_category", "_court"))))
    questions = _kept(questions.select("_question", "_terms", "_word", "_category", "_court", "_lo", "_hi", "_most"))
    terms = questions.groupBy("_terms").agg(*[F.first(c).alias(c) for c in ("_word", "_category", "_court")], F.max("_most").alias("_most"))
    every = _kept((df.where(F.col(required).isNotNull()) if required else df).withColumn("_row", F.monotonically_increasing_id()))

    parts = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_first("_relevance"), F.asc("_tie"), F.asc("_row")]

    def first_of(rows: DataFrame, keys: list[str], most) -> DataFrame:
        """The first ``most`` rows of each of the ``keys``."""
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where((F.col("_n") <= MAX_LIMIT) & (F.col("_n") <= most)).drop("_n")

    most = F.lit(questions.agg(F.max("_most")).first()[0] or 0)
    texts = [keywords_text, categories, court]
    rows = every.select("_row", F.col(fault).alias("_fault"), F.col(relevance).alias("_relevance"), F.col(tiebreak).alias("_tie"),
                        *[F.col(c).alias(f"_t{i}") for i, c in enumerate(texts)])
    rows = first_of(rows, ["_t0", "_t1", "_t2", "_fault"], most).withColumn("_text", F.xxhash64(*[F.coalesce(f"_t{i}", F.lit("")) for i in range(3)]))
    rows = _kept(rows)
    found = _term_texts(rows, terms, "_t0", "_t1", "_t2", literal)  # _terms, _text and the texts
    found = found.select("_terms", "_most", F.col("_text").alias("_held"), *[F.col(f"_t{i}").alias(f"_h{i}") for i in range(3)])
    on = [F.col("_held") == F.col("_text"), *[F.col(f"_h{i}").eqNullSafe(F.col(f"_t{i}")) for i in range(3)]]
    found = found.repartition(parts, "_held").join(rows, on).select("_terms", "_most", "_fault", "_relevance", "_tie", "_row")
    found = _kept(first_of(found, ["_terms", "_fault"], F.col("_most")))

    fits = (F.col("_lo").isNull() | (F.col("_fault") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_fault") <= F.col("_hi")))
    bounds = questions.groupBy("_terms", "_lo", "_hi").agg(F.max("_most").alias("_most"))
    met = found.drop("_most").repartition(parts, "_terms").join(bounds, "_terms").where(fits).drop("_fault")
    met = _kept(first_of(met, ["_terms", "_lo", "_hi"], F.col("_most")).drop("_most"))
    met = met.withColumnsRenamed({"_terms": "_set", "_lo": "_from", "_hi": "_upto"})
    same = [F.col("_terms") == F.col("_set"), F.col("_lo").eqNullSafe(F.col("_from")), F.col("_hi").eqNullSafe(F.col("_upto"))]
    met = questions.join(met, same).select("_question", "_most", "_relevance", "_tie", "_row").distinct()  # a row can hold several words
    met = first_of(met, ["_question"], F.col("_most")).drop("_most")
    best = Window.partitionBy("_question").orderBy(*order)
    met = met.withColumn("_n", F.row_number().over(best))
    met = asked.select(request_col, "_question", "_limit").join(met, "_question").where(F.col("_n") <= F.col("_limit"))
    w = Window.partitionBy(request_col).orderBy(*order)
    ranked = met.withColumn(rank_col, F.row_number().over(w)).where((F.col(rank_col) <= MAX_LIMIT) & (F.col(rank_col) <= F.col("_limit")))
    return ranked.select(request_col, rank_col, "_row").join(every, "_row").select(*df.columns, request_col, rank_col)


def _kept(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder, so that it is made once."""
    path = scratch_path(df.sparkSession, "searches", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ALL_BUCKETS = 64
SPREAD = 2  # times the usual number of tasks for tables that a join makes many times larger, which the planner would deal over few


def _term_texts(rows: DataFrame, terms: DataFrame, keywords_text: str, categories: str, court: str, literal: bool) -> DataFrame:
    """``terms`` with the distinct texts (and ``_text``, their hash) that match them: ``_terms, _most, _text`` and the texts."""
    texts = {"k": keywords_text, "c": categories, "o": court}
    held = rows.select("_text", *texts.values()).distinct()  # a shared hash costs a look, ILIKE decides

    one = lambda field, c: F.struct(F.lit(field).alias("field"), F.col(c).alias("term"))
    each = terms.select("_terms", F.explode(F.array(one("k", "_word"), one("c", "_category"), one("o", "_court"))).alias("t"))
    each = each.select("_terms", "t.*").where("term IS NOT NULL").withColumn("grams", pattern_grams("term", literal))
    wanted = each.select("field", F.explode("grams").alias("gram")).distinct()
    of = F.array(*[F.struct(F.lit(f).alias("field"), text_grams(c).alias("grams")) for f, c in texts.items()])
    postings = held.select("_text", F.explode(of).alias("f")).select("_text", "f.field", F.explode("f.grams").alias("gram")).distinct()
    postings = _kept(postings.join(wanted, ["field", "gram"]))

    often = postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    costs = each.select("_terms", "field", F.explode("grams").alias("gram")).join(often, ["field", "gram"], "left")
    way = costs.groupBy("_terms").agg(F.min_by(F.struct("field", "gram"), F.struct(F.coalesce("n", F.lit(0)), "field", "gram")).alias("way"))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(ALL_BUCKETS - 1)), lambda i: i.cast("string"))
    ways = terms.join(way, "_terms", "left").select("_terms", F.coalesce("way.field", F.lit("*")).alias("field"),
                                                    F.explode(F.when(F.col("way").isNotNull(), F.array("way.gram")).otherwise(buckets)).alias("gram"))

    every = held.select(F.lit("*").alias("field"), F.pmod("_text", F.lit(ALL_BUCKETS)).cast("string").alias("gram"), "_text").distinct()
    met = ways.join(postings.unionByName(every, allowMissingColumns=False), ["field", "gram"]).select("_terms", "_text")
    fits = lambda c, term: F.col(term).isNull() | ilike_contains(c, F.col(term), literal)
    return (met.join(terms, "_terms").join(held, "_text").where(fits(keywords_text, "_word") & fits(categories, "_category") & fits(court, "_court"))
            .select("_terms", "_most", "_text", *texts.values()))


def keyword_filter_latest(df: DataFrame, text: str, keyword: str | None, order: str, tiebreak: str,
                          n: int = 10, literal: bool = False) -> DataFrame:
    """F3 + O3: optional substring filter, newest first (nulls first), top ``n``."""
    rows = df.where(ilike_contains(text, keyword, literal)) if keyword else df
    return rows.orderBy(F.desc_nulls_first(order), F.desc_nulls_first(tiebreak)).limit(n)


def array_keyword_match(df: DataFrame, array_col: str, keywords: list[str], mode: str = "any") -> DataFrame:
    """exact element containment in a keyword array (the GIN-indexed shape).

    ``any`` = arrays overlap (``&&``), ``all`` = contains every keyword (``@>``).
    """
    if mode == "all":
        cond = F.lit(True)
        for k in keywords:
            cond = cond & F.array_contains(F.col(array_col), F.lit(k))
    else:
        cond = F.arrays_overlap(F.col(array_col), F.array(*[F.lit(k) for k in keywords]))
    return df.where(F.coalesce(cond, F.lit(False)))


def keyword_index(df: DataFrame, id_col: str, array_col: str, keyword_col: str = "keyword") -> DataFrame:
    """The GIN index as a table: one (keyword, id) row per distinct keyword of a row.

    Stored sorted by keyword (``write_keyword_index``) it serves repeated
    lookups with row-group skipping instead of full scans.
    """
    return df.select(F.explode(F.array_distinct(F.col(array_col))).alias(keyword_col), F.col(id_col))


def write_keyword_index(index: DataFrame, path: str, id_col: str, keyword_col: str = "keyword") -> DataFrame:
    """Store the index, ranges of (keyword, id) a file and sorted inside it; returns the stored table."""
    index.repartitionByRange(keyword_col, id_col).sortWithinPartitions(keyword_col, id_col).write.mode("errorifexists").parquet(path)
    return index.sparkSession.read.parquet(path)


def index_lookup(index: DataFrame, keywords: list[str], id_col: str, mode: str = "any",
                 keyword_col: str = "keyword") -> DataFrame:
    """Ids whose keyword set overlaps (``any``) or contains (``all``) ``keywords``.

    A pushed-down filter on the keyword column, then a distinct / count per id
    -- both partial aggregates, so a keyword shared by a third of the rows is
    reduced before the shuffle.
    """
    wanted = sorted(set(keywords))
    hits = index.where(F.col(keyword_col).isin(*wanted))
    if mode == "all":
        return (hits.groupBy(id_col).agg(F.count_distinct(keyword_col).alias("_n"))
                    .where(F.col("_n") == len(wanted)).select(id_col))
    return hits.select(id_col).distinct()
