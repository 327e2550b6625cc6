"""Quotation linking: nested quotes in messages, joined to the messages they come from.

Only DataFrame functions. Passages are cut inside each row; the joins run on
(conversation, hash of the passage), so a long conversation spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

MARK = "^([ \\t]*>)+"
#: A line of these endings that stands right before a quote names its author; it is no text of the reply.
ATTRIBUTION = "(wrote|writes|schrieb|a écrit|escribió)[ \\t]*:[ \\t]*$"


def normalised(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\r\\n\\f]+", " "))


def _parsed(messages: DataFrame, text: str) -> DataFrame:
    """Message rows with ``lines``: (level, body) and ``starts``: where each passage begins."""
    m = messages.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    m = m.withColumn("lines", F.transform("_l", lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[ \\t]", "")).alias("level"),
        F.regexp_replace(x, MARK, "").alias("body"))))
    line = lambda i: F.element_at("lines", i)
    blank = lambda x: F.trim(F.regexp_replace(x["body"], "[ \\t\\r\\f]+", " ")) == ""
    n = F.size("lines")
    m = m.withColumn("lines", F.transform("lines", lambda x, i: F.struct(
        x["level"].alias("level"), x["body"].alias("body"), blank(x).alias("blank"),
        ((x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (i + 1 < n)
         & (F.get("lines", i + 1)["level"] > 0)).alias("names"))))
    own = lambda i: ~line(i)["blank"] & ~line(i)["names"]
    return m.withColumn("starts", F.filter(F.sequence(F.lit(1), n), lambda i: own(i) & (
        (i == 1) | F.coalesce(~own(F.greatest(i - 1, F.lit(1))), F.lit(False))
        | (line(F.greatest(i - 1, F.lit(1)))["level"] != line(i)["level"])))).drop("_l")


def passages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv, turn, passage, level, lines``: the runs of lines of one quote level.

    A line's level is the number of ``>`` marks before its text. A passage ends where
    the level changes, at a line that is blank behind its marks, and at an attribution.
    """
    m = _parsed(messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text")), "text")
    # between the end of a passage and the next start there are only blank lines and attributions
    upto = lambda j: F.coalesce(F.get("starts", j + 1) - 1, F.size("lines"))
    parts = F.transform("starts", lambda s, j: F.struct(
        j.alias("passage"), F.element_at("lines", s)["level"].alias("level"),
        F.transform(F.filter(F.slice("lines", s, upto(j) - s + 1), lambda x: ~x["blank"] & ~x["names"]),
                    lambda x: x["body"]).alias("lines")))
    return m.select("conv", "turn", F.explode(parts).alias("p")).select("conv", "turn", "p.*")


def _units(p: DataFrame) -> DataFrame:
    """Hashes of whole passages (``line`` -1) and, of passages of several lines, of each line."""
    whole = F.struct(F.lit(-1).alias("line"), normalised(F.array_join("lines", " ")).alias("words"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("line"), normalised(x).alias("words")))
    all_ = F.when(F.size("lines") > 1, F.concat(F.array(whole), each)).otherwise(F.array(whole))
    return (p.select("conv", "turn", "passage", "level", F.explode(all_).alias("u"))
            .select("conv", "turn", "passage", "level", F.col("u.line").alias("line"), F.md5("u.words").alias("hash")))


def quote_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per quoted passage: ``conv, turn, passage, level, origin``.

    ``origin`` is the turn of the message the passage comes from: the first message of
    the conversation that has it as its own words and stands before the quote. The whole
    passage counts first; if no message has it, the first of its lines that one has.
    Null where none is found.
    """
    p = passages(messages, conv, turn, text)
    own = _units(p.where("level = 0")).groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    own = written(own, "own-passages")  # so that the join can split the quotes of one passage over many tasks
    quoted = _units(p.where("level > 0"))
    hit = quoted.join(own, ["conv", "hash"], "left")
    good = F.when(F.col("origin") < F.col("turn"), F.struct("line", "origin"))
    return (hit.groupBy("conv", "turn", "passage", "level").agg(F.min(good).alias("best"))
            .select("conv", "turn", "passage", "level", F.col("best.origin").alias("origin")))


def reply_roots(parents: DataFrame) -> DataFrame:
    """``conv, turn, parent`` to ``conv, turn, parent, root, depth`` by pointer doubling.

    A parent is an earlier turn, so there is no cycle; the number of rounds is the
    logarithm of the longest chain. Every round is a written table.
    """
    now = parents.select("conv", "turn", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    now = written(now, "reply-roots", free=False)
    while True:
        up = now.select(F.col("conv").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"))
        step = now.join(up, (now["conv"] == up["u_conv"]) & (now["up"] == up["u_turn"]), "left")
        if step.where("u_up IS NOT NULL").isEmpty():
            return now.withColumnRenamed("up", "root")
        now = written(step.select("conv", "turn", "parent", F.coalesce("u_up", "up").alias("up"),
                                  (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth")), "reply-roots", free=False)


def reply_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """All messages without quotes, in reply order.

    Adds ``body`` (the text's own lines without quotes and attributions, no blank lines
    at the ends), ``n_quotes``, ``n_linked`` (passages, and those with an origin), ``parent_turn`` (the
    origin of the first linked passage of the lowest level; null: the message opens a
    thread), ``thread_turn`` (the turn that opened the thread; its own without a parent)
    and ``depth``. The result is range-partitioned and sorted by conversation, thread
    and turn: a reply stands behind what it answers, and threads stay together. One
    row per message, so a conversation of any length needs no single task.

    Nulls: a null text is empty; a message with a null conversation or turn links to
    nothing. Messages that repeat conversation and turn share their links. Columns of
    the added names are replaced; others pass through. An empty table gives an empty
    result.
    """
    added = ("body", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth")
    kept = [c for c in messages.columns if c not in added]
    links = written(quote_links(messages, conv, turn, text), "quote-links", free=False)
    per = links.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "passage", "origin"))).alias("first"))
    per = written(per.select("conv", "turn", "n_quotes", "n_linked", F.col("first.origin").alias("parent")), "quote-parents", free=False)
    roots = reply_roots(per.where("parent IS NOT NULL").select("conv", "turn", "parent"))
    known = (per.join(roots.select("conv", "turn", "root", "depth"), ["conv", "turn"], "left")
             .select(F.col("conv").alias("k_conv"), F.col("turn").alias("k_turn"), "n_quotes", "n_linked",
                     F.col("parent").alias("parent_turn"), "root", "depth"))
    rows = _parsed(messages.select(F.struct(*kept).alias("row"), F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                                   F.col(text).alias("text")), "text").select("row", "conv", "turn", _body().alias("body"))
    none = F.lit(0).cast("long")
    out = (rows.join(known, (rows["conv"] == known["k_conv"]) & (rows["turn"] == known["k_turn"]), "left")
           .withColumns({"n_quotes": F.coalesce("n_quotes", none), "n_linked": F.coalesce("n_linked", none),
                         "thread_turn": F.coalesce("root", "turn"), "depth": F.coalesce("depth", none)})
           .repartitionByRange("conv", "thread_turn", "turn").sortWithinPartitions("conv", "thread_turn", "turn"))
    return out.select("row.*", *added)


def _body() -> Column:
    own = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["names"]), lambda x: x["body"])
    return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), "^([ \\t\\r\\f]*\\n)+", ""), "(\\n[ \\t\\r\\f]*)+$", "")
