"""Links between rows that share inverted lists, and the components they form.

The number of pairs is kept near the number of list entries: a list first compares all
its members with its smallest one; only members that are still in different components
after that meet each other. Each entry carries a tag of a few bytes, so that most pairs of
unlike members are dropped where they arise. Lists where many pairs would be left meet in
lists of their own, by a prefix filter over the full sets of their members.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, written

PAIRS_PER_MEMBER = 16  # that a list may leave over after its tags; with more of them, its members go to the prefix filter
MEMBERS = 2000  # of a list whose tags are compared all with all
RECENT = 16  # values before one in a prefix that are looked at, so that a pair is made for its first shared value
SLICES, SLICE_ROWS = 8, 500_000  # parts of the values that meet one after the other, and rows from which one more is made
PROBES = 3  # members of a list that all its members are compared with, to tell how many pairs it would leave
FIELDS_PER_WORD = 31


def tag(size: Column, *words: Column) -> Column:
    """What an entry says of its row: the size of its set, and 2-bit MinHash values packed into longs."""
    return F.struct(size.cast("int").alias("size"), *[w.alias(f"w{i}") for i, w in enumerate(words)])


def alike(a: Column, b: Column, percent: int, words: int, fields: int, equal: int, bits: int = 2) -> Column:
    """Whether two tags allow a similarity of ``percent`` (80 or more).

    The sizes must allow it, and ``equal`` of the ``fields`` values of ``bits`` bits (2 or 4) must
    agree. Of 2 bits, a pair at 0.8 agrees in each with a chance of 0.85, one at 0.3 of 0.475.
    """
    differ = F.lit(0)
    for i in range(words):
        x = a[f"w{i}"].bitwiseXOR(b[f"w{i}"])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        if bits == 4:
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1555555555555555 if bits == 2 else 0x1111111111111111)))
    return sizes_allow(a, b, percent) & (differ <= fields - equal)


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return (a["size"] * 100 >= b["size"] * percent) & (b["size"] * 100 >= a["size"] * percent)


def parities_allow(a: Column, b: Column, percent: int, words: list[str]) -> Column:
    """Whether two tags allow a similarity of ``percent``, by bits that each member of a set flips one of.

    No chance is in it: sets differ in as many members as bits at least, and linked ones
    in no more than (|a| + |b|) * (100 - percent) / (100 + percent).
    """
    differ = F.lit(0)
    for w in words:
        differ = differ + F.bit_count(a[w].bitwiseXOR(b[w]))
    return sizes_allow(a, b, percent) & (differ * (100 + percent) <= (a["size"] + b["size"]) * (100 - percent))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that can be reached) of ``a, b`` edges.

    Distributed union-find by alternating stars: every node hangs its larger neighbours
    on its smallest one, then itself and its smaller neighbours. All steps are joins and
    minima on edges, written after each round; nothing is gathered per node. Nodes
    without an edge to another node are not in the result.
    """
    old, now = [], written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", free=False)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written, so that a join can split the neighbours of one node over many tasks
        old.append(now)
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "minima", free=False)
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        old.append(low)
        large = written(large, "stars", free=False)
        old.append(large)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "minima", free=False)
        small = large.join(low, large["a"] == low["u"])
        small = (small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        old.append(low)
        now = written(small, "stars", free=False)
        release(*old)
        old = []
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())


def shared_lists(entries: DataFrame) -> DataFrame:
    """The written entries ``key, id, tag`` of lists with two different ids or more, with their ``hub``, the smallest id."""
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    hubs = written(hubs, "hubs", free=False)
    lists = written(entries.join(hubs, "key"), "lists")
    release(hubs)
    return lists


def link(lists: DataFrame, values: DataFrame | Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame],
         near: Callable[[Column, Column], Column], percent: int = 80) -> DataFrame:
    """``node, component`` over the links that ``verify`` confirms among members of a list.

    ``lists``: the result of ``shared_lists``. ``values``: ``id, value``, the full sets of the
    members, or what makes them, each value once, of the ``id`` of some; linked sets have a similarity of
    ``percent`` or more. ``near`` says of two tags whether their rows can be linked.
    ``verify`` gets candidate pairs ``a, b`` (a < b, distinct, their tags near) and returns
    those that are linked.

    1. Each member of a list is compared with the list's hub.
    2. Lists whose members all lie in one component are done, a large group of near
       copies among them. In the others, members of different components are compared,
       if their tags leave few pairs. That is counted against ``PROBES`` members of the list.
    3. Members of lists that would leave more than ``PAIRS_PER_MEMBER`` pairs for each member, or
       that have more than ``MEMBERS`` members, are compared with the probes of one of their
       lists, which joins most of a large group; then they meet by ``prefix_pairs``.

    No pair that can be linked is left out, whichever way a list goes.
    """
    hub = lists.where("id = hub").select("key", "hub", F.col("tag").alias("hub_tag")).distinct()
    first = (lists.where("id != hub").join(hub, ["key", "hub"]).where(near(F.col("tag"), F.col("hub_tag")))
             .select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    first = written(first, "hub-pairs")
    links = written(verify(first), "links")
    label = written(components(links), "components", free=False)
    release(links)

    def placed(rows: DataFrame) -> DataFrame:
        """``rows`` with the ``component`` of their ``id``."""
        return rows.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    members = placed(lists.select("key", "id", "tag").distinct())
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = written(sizes.where("lo < hi AND n > 2").select("key", "n"), "open-lists", free=False)  # at first the hub has compared both of two
    few = sizes.where(F.col("n") <= 2 * PAIRS_PER_MEMBER + 1).select("key")
    many = sizes.where(F.col("n") > 2 * PAIRS_PER_MEMBER + 1)
    done, tried = None, first
    if not many.isEmpty():
        rows = written(members.join(many, "key"), "large-lists")
        probe = [F.min(F.struct(F.xxhash64(F.lit(j), "id"), "id", "tag", "component")).alias(f"p{j}") for j in range(PROBES)]
        probed = rows.join(rows.groupBy("key").agg(*probe), "key")
        fits = [near(F.col("tag"), F.col(f"p{j}.tag")) & (F.col("component") != F.col(f"p{j}.component")) for j in range(PROBES)]
        left = probed.groupBy("key").agg(F.max("n").alias("n"), F.greatest(*[F.count_if(f) for f in fits]).alias("left"))
        dense = written(left.where((F.col("left") > PAIRS_PER_MEMBER) | (F.col("n") > MEMBERS)).select("key"), "dense-lists", free=False)
        few = few.unionByName(many.select("key").join(dense, "key", "left_anti"))
        if not dense.isEmpty():
            met = [F.when(f, F.col(f"p{j}.id")) for j, f in enumerate(fits)]
            one = probed.join(dense, "key").groupBy("id").agg(F.min_by(F.array_compact(F.array(*met)), F.xxhash64("key", "id")).alias("probes"), F.min("tag").alias("tag"))
            one = written(one, "dense-members")
            pairs = one.select("id", F.explode("probes").alias("o")).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
            pairs = written(pairs.join(first, ["a", "b"], "left_anti"), "probe-pairs")
            tried = tried.unionByName(pairs)
            release(rows)
            label = _joined(label, written(verify(pairs), "links"))
            sets = values(one.select("id")) if callable(values) else values.join(one.select("id"), "id", "left_semi").distinct()
            done = prefix_pairs(placed(one.select("id", "tag")), sets, percent, near)
            release(one)
    part = placed(lists.join(few, "key").select("key", "id", "tag").distinct())
    a = part.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("tag").alias("ta"))
    b = part.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("tag").alias("tb"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near(F.col("ta"), F.col("tb"))).select("a", "b")
    pairs = pairs if done is None else pairs.unionByName(done)
    rest = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    if rest.isEmpty():
        return label
    return _joined(label, written(verify(rest), "links"))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further written links, which are deleted."""
    if links.isEmpty():
        release(links)
        return label
    stars = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    out = written(components(stars.unionByName(links)), "components", free=False)
    release(links)
    return out


def prefix_pairs(members: DataFrame, values: DataFrame, percent: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``a, b`` (a < b, may repeat): all pairs of members of different components that can have a similarity of ``percent``.

    ``members``: ``id, tag, component``; ``values``: ``id, value``, their full sets, every value once. The values of a set are put
    in the order of their frequency among the members. Sets of x <= y values at the threshold share
    percent * (x + y) / (100 + percent) values or more, so the larger one holds a shared value among its
    first y - percent * y / 100 + 1 and the smaller one among its first x - 2 * percent * x / (100 + percent) + 1;
    and where they stand must leave enough values after the first shared one. What all
    members have in common comes last, so a group alike in less than that makes hardly a pair. A
    pair is made for its first shared value; only where that lies further back than ``RECENT`` values, again.
    The values are taken in up to ``SLICES`` parts, so that the shuffle files of one part are on disk at a time.
    """
    each = written(values.select("id", "value"), "set-values")
    often = written(each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "set-frequencies")
    n = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("id")  # the values of one set
    at = each.join(often, "value").withColumn("others", F.count(F.lit(1)).over(one)).withColumn("at", F.row_number().over(one.orderBy("df", "value")))
    at = at.join(n, "id").withColumn("at", F.col("at") + F.col("n") - F.col("others"))  # values of one set only come first
    at = at.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).join(members, "id")
    recent = F.collect_list("value").over(one.orderBy("at").rowsBetween(-RECENT, -1))
    at = written(at.select("value", "id", "n", "at", "tag", "component", recent.alias("recent")), "prefixes")
    release(each, often)
    slices = min(SLICES, 1 + at.count() // SLICE_ROWS)
    parts = [_prefix_pairs(at.where(F.pmod(F.xxhash64(F.lit("slice"), "value"), F.lit(slices)) == k), percent, near) for k in range(slices)]
    release(at)
    return functools.reduce(DataFrame.unionByName, parts)


def _prefix_pairs(at: DataFrame, percent: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``a, b`` (written): the pairs of ``prefix_pairs`` for the values of some prefixes."""
    short = at.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1)
    x = short.select("value", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "at", "tag", "component", "recent")])
    y = at.select("value", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "at", "tag", "component", "recent")])
    after = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    fits = ((F.struct("x_n", "x_id") < F.struct("y_n", "y_id")) & (F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("x_component") != F.col("y_component"))
            & (after * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent) & near(F.col("x_tag"), F.col("y_tag"))
            & ~F.arrays_overlap("x_recent", "y_recent"))
    out = x.join(y, "value").where(fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    return written(out, "prefix-pairs")
