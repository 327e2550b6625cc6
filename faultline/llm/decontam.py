"""Benchmark decontamination with a positional inverted index of the corpus.

The index is partitioned by documents: a row holds the postings of one segment (about a MB
of text): its terms, and for each term the sorted positions where it stands. A phrase is
found by intersecting the lists of its terms, each shifted by the term's offset in the
phrase, from the rarest term of the whole corpus on. Lists never leave their segment, so
a term that every document has is as cheap as its share of each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, null_safe, release, written

WINDOW = 10
GAP = 64  # free positions between documents of a segment: no match reaches over
SEGMENT_BYTES = 1 << 20  # what Python holds of a segment is about 31 times as much; Spark's writers look at their size every 100 rows only
BLOCK_WORDS = 2_000_000  # benchmark words that are searched for in one pass over the index

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of words: those of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(_BASE)
    return np.multiply.accumulate(out)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of all texts, and the number of words of each text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = np.flatnonzero(_IN_WORD[data])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[data[at]] * _powers(int(size.max()))[inside], first)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = np.diff(np.searchsorted(at[first], ends), prepend=0)
    return h.view(np.int64), n


def _segment_row(ids: list, ths: list, texts: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    words, n = hashed_words(texts)
    start = np.cumsum(n + GAP) - n
    position = (np.arange(len(words)) + np.repeat(start - (np.cumsum(n) - n), n)).astype(np.int32)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.ones(len(words), bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    first = np.flatnonzero(new)
    columns = [ids, ths, n.astype(np.int32), start.astype(np.int32), sorted_words[first],
               np.diff(np.append(first, len(words))).astype(np.int32), position[order]]
    return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index: one row per segment.

    ``ids, ths`` (document id and hash of its text), ``n_words, starts`` (by document),
    ``terms`` (sorted hashes), ``counts`` (postings of each) and ``positions`` (the lists,
    one behind the other). All words of all whole texts are in it; a null text has none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in (
        ("ids", id_type), ("ths", T.LongType()), ("n_words", T.IntegerType()), ("starts", T.IntegerType()),
        ("terms", T.LongType()), ("counts", T.IntegerType()), ("positions", T.IntegerType()))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, texts, size, schema = [], [], [], 0, None
        for b in batches:
            if schema is None:
                i32, i64 = pa.list_(pa.int32()), pa.list_(pa.int64())
                schema = pa.schema([("ids", pa.list_(b.schema.field(0).type)), ("ths", i64), ("n_words", i32), ("starts", i32),
                                    ("terms", i64), ("counts", i32), ("positions", i32)])
            for i, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(i)
                ths.append(th)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= segment_bytes:
                    yield _segment_row(ids, ths, texts, schema)
                    ids, ths, texts, size = [], [], [], 0
        if ids:
            yield _segment_row(ids, ths, texts, schema)

    return written(bounded_batches(rows, "4m").mapInArrow(segments, out), "positions")


class Windows:
    """The phrases of a block of items: ``words`` (phrase x offset, -1 where shorter), ``size`` and ``items``."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        hashes, n = hashed_words([t for _, t in items])
        at = np.cumsum(n) - n
        phrases: dict[tuple, set[str]] = {}
        for (item, _), a, k in zip(items, at, n, strict=True):
            for i in range(max(1, k - window + 1) if k else 0):
                phrases.setdefault(tuple(hashes[a + i:a + min(i + window, k)].tolist()), set()).add(item)
        self.items = [sorted(x) for x in phrases.values()]
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(p, np.int64) for p in phrases]]))
        self.words = np.full((len(phrases), window), -1, np.int64)
        for row, p in enumerate(phrases):
            self.words[row, :len(p)] = np.searchsorted(self.vocabulary, p)

    def from_the_rarest(self, counts: np.ndarray) -> None:
        """Order every phrase's offsets by the corpus counts; drop phrases with a term that the corpus lacks."""
        count = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        there = np.flatnonzero((count > 0).all(1)) if len(count) else np.zeros(0, np.int64)
        self.words, self.size, self.items = self.words[there], self.size[there], [self.items[i] for i in there]
        self.order = np.argsort(count[there], axis=1, kind="stable")


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of ``vocabulary`` stands in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                terms, counts = _lists(b, row, "terms", "counts")
                at = np.searchsorted(terms, vocabulary)
                ok = at < len(terms)
                ok[ok] = terms[at[ok]] == vocabulary[ok]
                total[ok] += counts[at[ok]]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["term", "n"])

    got = bounded_batches(index, "4m").select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[got["term"]] = got["n"]
    return out


def _shifted(windows: Windows, terms: np.ndarray, ptr: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per phrase of a segment: its starts, and whether each is exact (else all terms are within ``slop`` of their place)."""
    at = np.searchsorted(terms, windows.vocabulary)
    at[at == len(terms)] = 0
    at = np.where(terms[at] == windows.vocabulary, at, -1) if len(terms) else np.full(len(at), -1)
    here = np.append(at, -2)[windows.words]  # -2: no word at this offset
    for i in np.flatnonzero((here != -1).all(1)):
        offsets = windows.order[i, :windows.size[i]]
        lists = here[i]
        o = int(offsets[0])
        starts = positions[ptr[lists[o]]:ptr[lists[o] + 1]].astype(np.int64) - o
        exact = np.ones(len(starts), bool)
        for o in offsets[1:].tolist():
            line = positions[ptr[lists[o]]:ptr[lists[o] + 1]]
            if slop:
                k = np.minimum(np.searchsorted(line, starts + (o - slop)), len(line) - 1)
                ok = np.abs(line[k] - (starts + o)) <= slop
                e = np.minimum(np.searchsorted(line, starts + o), len(line) - 1)
                exact = (exact & (line[e] == starts + o))[ok]
            else:
                k = np.minimum(np.searchsorted(line, starts + o), len(line) - 1)
                ok = line[k] == starts + o
                exact = exact[ok]
            starts = starts[ok]
            if not len(starts):
                break
        else:
            yield int(i), starts, exact


def find_phrases(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id, th, item, first, last, exact``: runs of a document's words that match an item's windows.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. Exact matches have the words one behind the other; with ``slop``
    there are also proximity matches, where every word of the window stands at most that
    many words from its place. Overlapping matches of one item, document and kind are
    one row (words ``first`` to ``last`` of the document).

    The items are searched for in blocks of about ``block_words`` words, so what a pass
    holds is bounded however large the benchmark is. Null item ids count as the empty
    id, null texts have no words, repeated ids are one item.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2  # two bytes a word at least
    n_blocks = max(1, -(-words // block_words))
    spark, found = index.sparkSession, []
    id_type = index.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("item", T.StringType()),
                        T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("exact", T.BooleanType())])
    for block in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        windows = Windows([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()], window)  # one block
        if len(windows.size):
            windows.from_the_rarest(term_counts(index, windows.vocabulary))
        if len(windows.size):
            found.append(bounded_batches(index, "4m").mapInArrow(_search(spark.sparkContext.broadcast(windows), slop), out))  # bounded by block_words
    if not found:
        return spark.createDataFrame([], out)
    result = found[0]
    for f in found[1:]:
        result = result.unionByName(f)
    return result


def _search(shared, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for b in batches:
            for row in range(b.num_rows):
                n_words, start, terms, counts, positions = _lists(b, row, "n_words", "starts", "terms", "counts", "positions")
                ptr = np.concatenate([[0], np.cumsum(counts)])
                runs: dict[tuple, list] = {}
                for i, starts, exact in _shifted(windows, terms, ptr, positions, slop):
                    anchor = starts + int(windows.order[i, 0])
                    doc = np.searchsorted(start, anchor, side="right") - 1
                    first = np.maximum(starts - start[doc], 0)
                    last = np.minimum(starts - start[doc] + int(windows.size[i]), n_words[doc]) - 1
                    for d, a, z, e in zip(doc.tolist(), first.tolist(), last.tolist(), exact.tolist(), strict=True):
                        for item in windows.items[i]:
                            runs.setdefault((d, item, e), []).append((a, z))
                rows = []
                for (d, item, e), spans in runs.items():
                    for a, z in sorted(spans):
                        if rows and rows[-1][0] == d and rows[-1][1] == item and rows[-1][4] == e and a <= rows[-1][3] + 1:
                            rows[-1][3] = max(rows[-1][3], z)
                        else:
                            rows.append([d, item, a, z, e])
                if rows:
                    d, item, a, z, e = zip(*rows, strict=True)
                    take = pa.array(d, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("ids")[row].values.take(take), b.column("ths")[row].values.take(take), pa.array(item, pa.string()),
                         pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(e, pa.bool_())],
                        names=["id", "th", "item", "first", "last", "exact"])
    return search


def judge_documents(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Every document of the index: ``id, th, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit``: words inside any match; ``n_items``: items with a match; the digest is of
    their ids, sorted as strings and joined by commas. Rows that repeat id and text are
    judged alike, a null id like any other.
    """
    docs = index.select(F.explode(F.arrays_zip("ids", "ths", "n_words")).alias("d")).select(
        F.col("d.ids").alias("id"), F.col("d.ths").alias("th"), F.col("d.n_words").cast("long").alias("n_words"))
    runs = matches.select("id", "th", "first", "last").distinct()
    by_start = Window.partitionBy("id", "th").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, reached))
    hits = runs.withColumn("new", new).groupBy("id", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    items = matches.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.join(items, null_safe(hits, items, ["id", "th"])).select(
        hits["id"].alias("h_id"), hits["th"].alias("h_th"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return (docs.join(both, docs["id"].eqNullSafe(both["h_id"]) & (docs["th"] == both["h_th"]), "left")
            .select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; its columns unchanged."""
    index = build_index(docs, id_col, text_col)
    found = find_phrases(index, items, window=window)
    bad = written(found.select(F.col("id").alias("_bad_id"), F.col("th").alias("_bad_th")).distinct(), "contaminated")
    release(index)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (_text_hash(text_col) == bad["_bad_th"]), "left_anti")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
