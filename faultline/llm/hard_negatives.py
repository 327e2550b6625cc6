"""Hard negatives by an inverted multi-index.

Each half of the vectors has a codebook of its own; a pair of codes is a cell. A code's
centre and radius bound the score that its half can add, so the sum over both halves
bounds every row of a cell. Each query visits the cells from the highest bound down, in
rounds, until what it has found is certain: no cell that is left can reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

SAMPLE = 8192  # distinct vectors that the codebooks are fitted on; every row is indexed
ROWS_PER_CELL = 1024
MAX_CODES = 256  # of a half: the cells, at most their square, are known to every task
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024  # rows and queries that one comparison holds at most, about
FIRST_ROWS, MORE = 8192, 8  # rows of the cells of a query's first round, and how many times more each further one takes
SLACK = 0.01  # scores are whole numbers; the bounds are rounded


class Codes(NamedTuple):
    """Centres and radii of one half."""

    centre: np.ndarray
    radius: np.ndarray


class Index(NamedTuple):
    rows: DataFrame  # cell, block, label, ids (the smallest, sorted), vec (binary)
    cells: DataFrame  # cell, n, blocks
    halves: tuple[Codes, Codes]
    sizes: dict[int, int]  # rows of each cell
    kind: str  # of the numbers in vec


def _matrix(vecs, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), kind).reshape(-1, dim).astype(np.float64)


def _codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` groups of the rows of ``x`` (k-means, from rows evenly spread in their order)."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, centre)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """``cls, label, vec, ids`` of ``id, label, vec``: the ``keep`` smallest ids of each label and vector, written.

    Rows of one label and vector have the same score with any other, and ties go by id, so
    more of them are never among the first ``keep``. They are cut in the tasks that read them.
    """
    rank = F.row_number().over(Window.partitionBy("h", "label", "vec").orderBy("id"))
    first = vectors.withColumn("h", F.xxhash64("vec")).withColumn("rank", rank).where(F.col("rank") <= keep)
    groups = first.groupBy("h", "label", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return written(groups.select(F.monotonically_increasing_id().alias("cls"), "label", "vec", "ids"), "vector-classes")


def build_index(rows: DataFrame, sample: int = SAMPLE, rows_per_cell: int = ROWS_PER_CELL) -> Index:
    """The multi-index over the result of ``classes``.

    The codebooks come from ``sample`` rows drawn by hash. Vectors that are shorter than
    the longest one count as filled up with zeros.
    """
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    dim, kind = max(dim or 0, 2), "<i2" if (most or 0) < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    half = dim // 2

    def full(v) -> np.ndarray:
        return np.pad(np.asarray(v, np.int64), (0, dim - len(v)))

    drawn = rows.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("vec").toPandas()["vec"]
    x = np.array([full(v) for v in drawn], np.float64).reshape(-1, dim)
    k = int(min(max(np.sqrt(n / rows_per_cell), 1), MAX_CODES, max(len(x), 1)))
    parts = (x[:, :half], x[:, half:])
    centres = [_codebook(p, k) if len(p) else np.zeros((1, p.shape[1])) for p in parts]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = np.array([full(v) for v in b.column("vec").to_pylist()], np.int64).reshape(-1, dim)
            codes, away = [], []
            for p, c in zip((ints[:, :half], ints[:, half:]), centres, strict=True):
                codes.append(_nearest(p, c))
                away.append(np.sqrt(((p - c[codes[-1]]) ** 2).sum(1)))
            vecs = [v.tobytes() for v in ints.astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), b.column("label"), b.column("ids"), pa.array(vecs, pa.binary()), pa.array(codes[0] * k + codes[1], pa.int32()),
                 *[pa.array(c, pa.int32()) for c in codes], *[pa.array(a, pa.float64()) for a in away]],
                names=["cls", "label", "ids", "vec", "cell", "c0", "c1", "r0", "r1"])

    label = rows.schema["label"].dataType.simpleString()
    schema = f"cls long, label {label}, ids array<long>, vec binary, cell int, c0 int, c1 int, r0 double, r1 double"
    placed = written(bounded_batches(rows).select("cls", "label", "ids", "vec").mapInArrow(assign, schema), "vector-cells")
    halves = []
    for h, c in enumerate(centres):
        radius = np.zeros(len(c))
        for r in placed.groupBy(f"c{h}").agg(F.max(f"r{h}").alias("r")).collect():  # MAX_CODES rows at most
            radius[r[0]] = r["r"]
        halves.append(Codes(c, radius))
    cells = written(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")), "cells", free=False)
    sizes = {r["cell"]: r["n"] for r in cells.collect()}  # MAX_CODES ** 2 rows at most
    blocks = placed.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    return Index(blocks.select("cls", "label", "ids", "vec", "cell", "block"), cells, (halves[0], halves[1]), sizes, kind)


def multi_sequence(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All ``(u[i] + v[j], i, j)`` from the highest sum down, by a heap over the two sorted sequences."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap = [(-(u[a[0]] + v[b[0]]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(u[a[i]] + v[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(u[a[i + 1]] + v[b[0]]), i + 1, 0))


def _plan(index: Index, rows: int):
    """Of queries ``q, label, vec, passed``: the cells of the next round, and the bound of all that follow (null: none)."""
    halves, sizes, kind = index.halves, index.sizes, index.kind
    dim, k = sum(h.centre.shape[1] for h in halves), len(halves[1].centre)
    half = halves[0].centre.shape[1]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec").to_pylist(), kind, dim)
            bounds = [p @ h.centre.T + np.sqrt((p * p).sum(1))[:, None] * h.radius for p, h in zip((x[:, :half], x[:, half:]), halves, strict=True)]
            cells, passed, rest = [], [], []
            for u, v, before in zip(*bounds, b.column("passed").to_pylist(), strict=True):
                own, n, at, left = [], 0, 0, None
                for bound, i, j in multi_sequence(u, v):
                    size = sizes.get(i * k + j, 0)
                    if not size:
                        continue
                    at += 1
                    if at <= before:
                        continue
                    if n >= rows:
                        left = bound + SLACK
                        break
                    own.append(i * k + j)
                    n += size
                cells.append(own)
                passed.append(before + len(own))
                rest.append(left)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("label"), b.column("vec"), pa.array(cells, pa.list_(pa.int32())),
                                              pa.array(passed, pa.int32()), pa.array(rest, pa.float64())],
                                             names=["q", "label", "vec", "cells", "passed", "rest"])

    return plan


def search(index: Index, queries: DataFrame, windows: DataFrame, keep: int, same_label: bool) -> DataFrame:
    """``q, lo, hi, score, id``: the first ``keep`` rows of each window, by score and then smallest id, written.

    ``queries``: ``q, label, vec`` (binary, as in the index). ``windows``: ``q, lo, hi``,
    the scores that count, both ends included. Rows have the query's label, or, with
    ``same_label`` false, another one. Exact: a query goes on until every window of it
    is full above the bound of the cells that are left, or that bound lies below it.
    """
    dim = sum(h.centre.shape[1] for h in index.halves)
    kind, label = index.kind, index.rows.schema["label"].dataType.simpleString()
    chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    chunk = F.pmod(F.xxhash64(F.col("q"), F.lit(7)), F.lit(chunks)).cast("int")
    rows = index.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else index.rows.withColumn("chunk", F.lit(0))
    keys = ["cell", "block", "chunk"]

    def compare(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({c: [] for c in ("q", "lo", "hi", "score", "id")}).astype("int64")
        each = rs["ids"].map(len).to_numpy()
        ids = np.concatenate(rs["ids"].to_list()).astype(np.int64)
        order = np.argsort(ids)  # ties then stand in order of id
        ids, of = ids[order], np.repeat(np.arange(len(rs)), each)[order]
        labels = rs["label"].to_numpy()[of]
        scores = _matrix(qs["vec"], kind, dim) @ _matrix(rs["vec"], kind, dim).T
        out = []
        for s, q, own, los, his in zip(scores, qs["q"], qs["label"], qs["los"], qs["his"], strict=True):
            at = np.flatnonzero((labels == own) == same_label)
            mine = s[of[at]]
            fits = (mine >= min(los)) & (mine <= max(his))
            at, mine = at[fits], mine[fits]
            sort = np.argsort(-mine, kind="stable")
            at, mine = at[sort], mine[sort]
            for lo, hi in zip(los, his, strict=True):
                i = int(np.searchsorted(-mine, -hi, "left"))
                j = min(i + keep, int(np.searchsorted(-mine, -lo, "right")))
                if j > i:
                    out.append((*[np.full(j - i, x) for x in (q, lo, hi)], mine[i:j].astype(np.int64), ids[at[i:j]]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(["q", "lo", "hi", "score", "id"], cols, strict=True)))

    per = windows.groupBy("q").agg(F.collect_list(F.struct("lo", "hi")).alias("w")).select("q", F.col("w.lo").alias("los"), F.col("w.hi").alias("his"))  # a few each
    open_ = queries.withColumn("passed", F.lit(0))
    first = Window.partitionBy("q", "lo", "hi").orderBy(F.desc("score"), "id")
    found, ready, n = None, [], FIRST_ROWS
    while True:
        plan = written(bounded_batches(open_).select("q", "label", "vec", "passed")
                       .mapInArrow(_plan(index, n), f"q long, label {label}, vec binary, cells array<int>, passed int, rest double"), "visits", free=False)
        visits = (plan.join(per, "q").withColumn("cell", F.explode("cells")).join(F.broadcast(index.cells), "cell")
                  .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", chunk)
                  .select(*keys, "q", "label", "vec", "los", "his"))
        new = visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compare, "q long, lo long, hi long, score long, id long")
        new = new if found is None else new.unionByName(found.join(plan.select("q"), "q", "left_semi"))
        found = written(new.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep).drop("rank"), "found")
        have = found.groupBy("q", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        sure = F.col("rest").isNull() | (F.col("rest") < F.col("lo")) | ((F.coalesce("n", F.lit(0)) >= keep) & (F.col("least") > F.col("rest")))
        done = windows.join(plan.select("q", "rest"), "q").join(have, ["q", "lo", "hi"], "left").groupBy("q").agg(F.min(F.coalesce(sure, F.lit(False))).alias("sure"))
        done = written(done, "certified", free=False)
        ready.append(found.join(done.where("sure"), "q", "left_semi"))
        open_ = plan.join(done.where("NOT sure"), "q", "left_semi")
        if open_.isEmpty():
            break
        n *= MORE
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return written(out, "search")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         sample: int = SAMPLE, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``id long, label, vec array<long>``, without nulls; other columns are
    ignored except by ``is_anchor``. A row's score is its inner product with the anchor;
    higher ones come first, ties by smaller id. Positives of an anchor are its first
    other rows of the same label. Of each anchor and positive, the negatives are the first
    rows of other labels with low * positive <= 100 * negative <= high * positive. All rows
    are searched, through the index; the scores are exact below 2^53. A rows' copies (one
    label and vector) are compared once, however many there are, and so are anchors with
    one label and vector. Rows that repeat an id count as often as they occur. An empty
    table, or one without an anchor, gives an empty result.
    """
    keep = max(positives + 1, negatives)
    rows = classes(vectors.select("id", "label", "vec"), keep)
    index = build_index(rows, sample, rows_per_cell)
    asked = vectors.where(is_anchor).select(F.col("id").alias("anchor_id"), "label", F.xxhash64("vec").alias("h"), "vec")
    named = rows.select(F.col("cls").alias("q"), "label", F.xxhash64("vec").alias("h"), "vec")
    anchors = written(asked.join(named, ["h", "label", "vec"]).select("anchor_id", "q", F.monotonically_increasing_id().alias("row")), "anchors")
    queries = written(index.rows.join(anchors.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("q"), "label", "vec"), "queries")
    far = (1 << 62)
    near = search(index, queries, queries.select("q", F.lit(-far).cast("long").alias("lo"), F.lit(far).cast("long").alias("hi")), positives + 1, True)
    # the anchor itself goes, once; one more than needed was kept for that
    pairs = anchors.join(near.select("q", F.col("id").alias("positive_id"), "score"), "q").withColumn("self", F.col("positive_id") == F.col("anchor_id"))
    pairs = pairs.withColumn("own", F.row_number().over(Window.partitionBy("row", "self").orderBy("score"))).where("NOT self OR own > 1")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    pairs = written(pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
                    .select("q", "anchor_id", "positive_id", F.col("score").alias("positive_score")), "positives")
    limits = pairs.select("q", "positive_score").distinct()
    lo = F.expr(f"CAST(ceil(CAST({low} * positive_score AS DECIMAL(38,0)) / 100) AS LONG)")
    hi = F.expr(f"CAST(floor(CAST({high} * positive_score AS DECIMAL(38,0)) / 100) AS LONG)")
    limits = written(limits.select("q", "positive_score", lo.alias("lo"), hi.alias("hi")).where("lo <= hi"), "windows", free=False)
    hard = search(index, queries.join(limits, "q", "left_semi"), limits.select("q", "lo", "hi").distinct(), negatives, False)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("q", "lo", "hi").orderBy(F.desc("score"), "id")))
    ranked = ranked.join(limits, ["q", "lo", "hi"])
    out = pairs.join(ranked, ["q", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
