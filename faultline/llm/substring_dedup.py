"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of ``length`` bytes (a window) is named by the smallest hash of the grams in it, so
equal windows have equal names wherever they stand. Windows side by side with one name make
a segment. Segments whose name occurs twice or more, or that may hold a window twice, go,
each distinct one once with its number of places, to the task of their name. There their suffixes are sorted as far as
windows reach; breadth-first backward extension on the transform derives the common prefixes
by increasing value and stops at ``length``; the boundaries not found by then lie between
equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh, release, written

LENGTH = 200
#: Lengths of the grams that name windows, as shares of a window: the next one is used where
#: a name has more than ``BUCKET`` distinct segments; at the last a name is one content.
GRAMS = (0.2, 0.5, 0.8, 1.0)
BUCKET = 4096
PIECE = 1 << 20  # bytes of text that are named at a time, whatever the lengths of texts
CHUNK = 1 << 20  # bytes of segments of one transform, about

_BYTE = np.random.default_rng(111).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[:len(x) - (width - size)], x[width - size:])


def window_names(data: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of the grams of every window of ``data``, and the ties before each gram.

    A tie is a smallest gram of some window that another one with the same hash follows within a window.
    """
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    grams = length - gram + 1
    name = _sliding(np.minimum, h, grams)
    smallest = np.flatnonzero(_sliding(np.maximum, np.pad(name, grams - 1), grams) == h)
    tie = (h[smallest[1:]] == h[smallest[:-1]]) & (smallest[1:] - smallest[:-1] <= grams)
    ties = np.zeros(len(h) + 1, np.int64)
    ties[smallest[:-1][tie] + 1] = 1
    return name, np.cumsum(ties)


Segment = tuple[int, int, int, int, bool, bytes]


def segments(texts: list[bytes], gram: int, length: int) -> Iterator[Segment]:
    """``text, start, windows, name, tie, bytes``: the windows of every text, those side by side with one name together.

    Only a segment with a tie can hold one window twice.
    """
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        # a long text goes in pieces that share length - 1 bytes, so every window is in one of them
        for lo in range(0, max(len(t) - length + 1, 0), PIECE):
            batch.append((k, lo, t[lo:lo + PIECE + length - 1]))
            size += len(batch[-1][2])
            if size >= PIECE:
                yield from _batch_segments(batch, gram, length)
                batch, size = [], 0
    if batch:
        yield from _batch_segments(batch, gram, length)


def _batch_segments(batch: list[tuple[int, int, bytes]], gram: int, length: int) -> Iterator[Segment]:
    joined = b"".join(t for _, _, t in batch)
    size = np.fromiter((len(t) for _, _, t in batch), np.int64, len(batch))
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(batch)), size)
    with np.errstate(over="ignore"):
        name, ties = window_names(np.frombuffer(joined, np.uint8), gram, length)
    inside = of[:len(name)] == of[length - 1:]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | ~inside[:-1] | (of[1:len(name)] != of[:len(name) - 1])
    first = np.flatnonzero(new | ~inside)
    windows = np.diff(np.append(first, len(name)))
    keep = inside[first]
    first, windows = first[keep], windows[keep]
    tie = ties[first + windows + length - gram] > ties[first]
    columns = (of[first], first, windows, name[first].view(np.int64), tie)
    for k, a, n, x, again in zip(*[c.tolist() for c in columns], strict=True):
        yield batch[k][0], batch[k][1] + a - int(begin[k]), n, x, again, joined[a:a + n + length - 1]


def content(segment: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True)


# one transform


def rotation_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of ``t`` in the order of their first ``depth`` numbers, or more."""
    n, bits, h = len(t), max(int(t.max()).bit_length(), 1), 1
    key = t
    while 2 * h * bits <= 63:
        key = key << (h * bits) | np.roll(key, -h)
        h *= 2
    more = 63 // bits - h  # numbers that the key still has room for
    key = key << (more * bits) | np.roll(key, -h) >> ((h - more) * bits)
    h += more
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    single = first & np.append(first[1:], True)
    slots = np.flatnonzero(~single)
    while h < depth and len(slots):
        u = order[slots]
        after = u + h
        after[after >= n] -= n
        key = rank[u].astype(np.int64) << 32 | rank[after]
        sort = np.argsort(key)
        u, key = u[sort], key[sort]
        order[slots] = u
        first = np.ones(len(u), bool)
        first[1:] = key[1:] != key[:-1]
        rank[u] = np.maximum.accumulate(np.where(first, slots, 0))
        slots = slots[~(first & np.append(first[1:], True))]
        h *= 2
    return order


def short_prefixes(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the rotation of each place in ``order`` shares less than ``length`` numbers with the one before.

    Interval expansion: an interval holds the rotations that begin with one string; its
    backward extensions are the intervals of the string with one number put before it. In
    breadth-first order the end of an interval that no shorter string has ended is a common
    prefix of the string's length less one; only such intervals are extended further.
    """
    n = len(t)
    last = t[order - 1].astype(np.uint16)  # the transform
    by = np.argsort(last, kind="stable")
    step = np.empty(n, np.int32)  # from a rotation to the one that begins one number earlier
    step[by] = np.arange(n, dtype=np.int32)
    # a wavelet matrix of the transform: of every bit, the zeros before each place
    zeros, at = [], np.arange(n, dtype=np.int32)
    for bit in range(int(t.max()).bit_length() - 1, -1, -1):
        one = (last[at] >> bit & 1).astype(bool)
        zeros.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(~one, dtype=np.int32)]))
        at = np.concatenate([at[~one], at[one]])
    target = step[at]
    ended = np.zeros(n + 1, bool)
    ended[[0, n]] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        alone = hi - lo == 1
        single = step[lo[alone]]
        lo, hi = lo[~alone], hi[~alone]
        for z in zeros:
            lo0, hi0 = z[lo], z[hi]
            lo1, hi1 = z[n] + lo - lo0, z[n] + hi - hi0
            some0, some1 = hi0 > lo0, hi1 > lo1
            lo, hi = np.concatenate([lo0[some0], lo1[some1]]), np.concatenate([hi0[some0], hi1[some1]])
        size = hi - lo
        lo = np.concatenate([target[lo], single])
        hi = lo + np.concatenate([size, np.ones(len(single), np.int32)])
        new = ~ended[hi]
        lo, hi = lo[new], hi[new]
        ended[hi] = True
        if not len(lo):
            break
    return ended[:n]


def repeated_windows(parts: list[bytes], weight: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """``part, first, end``: the runs of windows that occur twice or more, a part counting as often as ``weight``."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    t = np.zeros(int(size.sum()) + len(parts), np.int64)  # 0 ends each part
    of = np.repeat(np.arange(len(parts)), size + 1)
    letter = np.ones(len(t), bool)
    letter[end] = False
    data = np.frombuffer(b"".join(parts), np.uint8)
    t[letter] = np.cumsum(np.bincount(data, minlength=256) > 0)[data]  # 1 and up, without gaps
    order = rotation_order(t, length)
    group = np.cumsum(short_prefixes(t, order, length))
    often = np.bincount(group, np.asarray(weight, np.float64)[of[order]]) >= 2
    again = np.zeros(len(t) + 1, bool)
    again[order] = often[group]
    again[:-1] &= np.arange(len(t)) + length <= end[of]
    change = np.flatnonzero(again[1:] != again[:-1]) + 1
    edge = np.concatenate([np.zeros(int(again[0]), np.int64), change])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(of[a])
        begin = int(end[k] - size[k])
        yield k, a - begin, b - begin


# on Spark


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[dict, list[bytes]]]:
    for b in batches:
        yield {c: b.column(c).to_pylist() for c in b.schema.names if c != column}, b.column(column).to_pylist()


def _name(gram: int, length: int, with_bytes: bool):
    """Of rows ``owner columns…, data``: ``owner columns…, at, n, key, s, tie`` of all segments, and their bytes if asked for."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, texts in _texts(batches, "data"):
            rows, n = {c: [] for c in [*owner, "at", "n", "key", "s", "tie", "data"]}, 0
            for k, at, windows, key, tie, data in segments(texts, gram, length):
                for c, values in owner.items():
                    rows[c].append(values[k])
                for c, x in zip(("at", "n", "key", "s", "tie"), (at, windows, key, content(data), tie), strict=True):
                    rows[c].append(x)
                if with_bytes:
                    rows["data"].append(data)
                n += len(data)
                if n >= 16 * PIECE:
                    yield _segment_rows(rows, with_bytes)
                    rows, n = {c: [] for c in rows}, 0
            yield _segment_rows(rows, with_bytes)

    return name


def _segment_rows(rows: dict[str, list], with_bytes: bool) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "n": pa.int32(), "tie": pa.bool_()}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items() if with_bytes or c != "data"})


def _transform(length: int):
    """Of rows ``seg, key, w, data``, sorted by key: ``seg, first, end``, the runs of windows that occur again."""

    def judged(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = list({r[0]: r for r in rows}.values())
        found = [(rows[k][0], a, b) for k, a, b in repeated_windows([r[2] for r in rows], [r[1] for r in rows], length)] if rows else []
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["seg", "first", "end"])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, before = [], 0, None
        for b in batches:
            for seg, key, w, data in zip(*[b.column(c).to_pylist() for c in ("seg", "key", "w", "data")], strict=True):
                if size >= CHUNK and key != before:
                    yield judged(rows)
                    rows, size = [], 0
                rows.append((seg, w, data))
                size += len(data)
                before = key
        yield judged(rows)

    return transform


def _judge(segs: DataFrame, level: int, length: int, bucket: int) -> DataFrame:
    """``seg, first, end`` of ``seg, key, w, data``: the runs of windows that occur twice or more.

    Names with more than ``bucket`` distinct segments are named anew by longer grams, which
    splits them and lets what is equal in them meet as one segment; at the last level a name
    is one window's content.
    """
    last = level == len(GRAMS) - 1
    small = segs
    if not last:
        many = segs.groupBy("key").agg(F.count(F.lit(1)).alias("segs")).where(F.col("segs") > bucket).select("key")
        many = written(many, "large-names", free=False)
        last = many.isEmpty()
        small = segs if last else segs.join(many, "key", "left_anti")
    out = bounded_batches(small.repartition("key").sortWithinPartitions("key").select("seg", "key", "w", "data")).mapInArrow(
        _transform(length), "seg long, first long, end long")
    if last:
        return out
    gram = round(GRAMS[level + 1] * length)
    large = segs.join(many, "key").select(F.col("seg").alias("parent"), F.col("w").alias("times"), "data")
    inner = written(bounded_batches(large).mapInArrow(_name(gram, length, True), "parent long, times long, at long, n int, key long, s long, tie boolean, data binary"), "inner-places")
    per = inner.groupBy("key", "s").agg(F.sum("times").alias("w"), F.min("data").alias("data"))
    per = written(per.withColumn("seg", F.monotonically_increasing_id()), "inner-segments")
    again = _judge(per, level + 1, length, bucket)
    places = inner.select("parent", "at", "key", "s").join(per.select("seg", "key", "s"), ["key", "s"])
    return out.unionByName(places.join(again, "seg").select(F.col("parent").alias("seg"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("end")).alias("end")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """``id, th, spans``: of each document with any, the byte ranges ``start, end`` that windows which occur twice or more cover.

    A document is its id and the hash ``th`` of its text; rows that repeat both count as
    often as they occur. The ranges may touch and overlap and have no order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))
    gram = round(GRAMS[0] * length)
    places = written(bounded_batches(rows).mapInArrow(_name(gram, length, False), "id long, th long, at long, n int, key long, s long, tie boolean"), "places")
    names = written(places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("tie").alias("tie")).where("n > 1 OR tie").select("key"), "names")
    live = written(places.drop("tie").join(names, "key"), "live-places")
    release(places, names)
    place = F.struct("id", "th", "at", "n")
    segs = live.groupBy("key", "s").agg(F.count(F.lit(1)).alias("w"), F.min(place).alias("p"))
    segs = written(segs.select(F.monotonically_increasing_id().alias("seg"), "key", "s", "w", "p.*"), "segments")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: [] for c in ("seg", "key", "w", "data")}
            for t, wanted in zip(b.column("data").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    data = t[x["at"]:x["at"] + x["n"] + length - 1]
                    if content(data) == x["s"]:  # texts with one id and hash could differ after all
                        for c in ("seg", "key", "w"):
                            cols[c].append(x[c])
                        cols["data"].append(data)
            yield pa.RecordBatch.from_arrays([*[pa.array(cols[c], pa.int64()) for c in ("seg", "key", "w")], pa.array(cols["data"], pa.binary())], names=list(cols))

    wanted = segs.groupBy("id", "th").agg(F.collect_list(F.struct("seg", "key", "s", "w", "at", "n")).alias("wanted"))  # those of one text
    texts = rows.join(wanted.select(F.col("id").alias("w_id"), F.col("th").alias("w_th"), "wanted"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    full = written(bounded_batches(texts).select("data", "wanted").mapInArrow(fetch, "seg long, key long, w long, data binary"), "segment-bytes")
    again = written(_judge(full, 0, length, bucket), "repeated-windows")
    release(full)
    found = again.groupBy("seg").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    found = written(segs.select("seg", "key", "s").join(found, "seg").select("key", "s", "runs"), "repeated-segments")
    cover = F.transform("runs", lambda r: F.struct((F.col("at") + r["first"]).alias("start"), (F.col("at") + r["end"] + (length - 1)).alias("end")))
    spans = live.join(found, ["key", "s"]).select("id", "th", cover.alias("spans"))
    out = written(spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(live, segs, again, found)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (the maximal removed byte ranges, in order) and ``kept`` (binary) added.

    Texts are UTF-8 bytes, null as empty. A byte goes if a string of ``length`` bytes over
    it also starts anywhere else, in any row; strings are judged on the input, and do not
    cross rows. What stays may begin or end inside a character, so it is binary. Existing
    columns of the three names are replaced. A text shorter than ``length`` stays whole; rows
    that repeat a text lose all of it if it is long enough. An empty table gives an empty result.
    """
    marks = repeated_spans(docs.select(id_col, text_col), id_col, text_col, length, bucket)
    docs = docs.drop(*[c for c in ("n_bytes", "spans", "kept") if c in docs.columns])
    kid, kth, raw, cut = (fresh(docs, x) for x in ("k_id", "k_th", "k_spans", "k_cut"))
    marks = marks.select(F.col("id").alias(kid), F.col("th").alias(kth), F.col("spans").alias(raw))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.join(marks, F.col(id_col).cast("long").eqNullSafe(F.col(kid)) & (F.xxhash64(text) == F.col(kth)), "left")

    @F.arrow_udf("struct<spans: array<struct<start: bigint, end: bigint>>, kept: binary>")
    def cut_out(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        spans, kept = [], []
        for t, r in zip(texts.cast(pa.binary()).to_pylist(), ranges.to_pylist(), strict=True):
            merged: list[dict] = []
            for x in sorted(r or [], key=lambda x: x["start"]):
                if merged and x["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(x)
            edges = [0, *[e for x in merged for e in (x["start"], x["end"])], len(t)]
            spans.append(merged)
            kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(spans, kind), pa.array(kept, pa.binary())], names=["spans", "kept"])

    out = bounded_batches(out).withColumn(cut, cut_out(text, F.col(raw)))
    return out.withColumns({"n_bytes": F.octet_length(text).cast("long"), "spans": F.col(f"{cut}.spans"), "kept": F.col(f"{cut}.kept")}).drop(kid, kth, raw, cut)
