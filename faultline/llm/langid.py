"""Language ID of spans: script ranges narrow the candidates, Viterbi labels the words.

Every word gets a score per language (log likelihood of its hashed letter 3- and 4-grams).
The script of its letters leaves only the languages that are written in it. The best
labelling of a text's words under a penalty for every switch gives its spans; the
language with the most letters is the text's language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches

UNDETERMINED = "und"
BUCKETS = 1 << 15  # per kind of n-gram
KINDS = 2
BLOCK = 64  # words that are decoded in one lockstep
BATCH_CHARS = 1 << 18  # texts taken at once; their arrays hold about 150 bytes a character
NOT_WRITTEN_SO = -1e4  # score of a language that does not use the word's script

# First and last code point of the main scripts' blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for a letter, 1 for a mark, else 0; its lower case, its script."""
    n = 0x110000
    chars = lambda: map(chr, range(n))  # noqa: E731 - made one by one: a list of them stays in the memory of every worker
    letter = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(c)[0], 0) for c in chars()), np.int8, n)
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars()), np.int32, n)
    script = np.zeros(n, np.int8)
    for name, a, b in SCRIPTS:
        script[a:b + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


@dataclass
class Words:
    """The words of a batch of texts: runs of letters and marks of one script, with a letter at least."""

    doc: np.ndarray  # text of each word
    start: np.ndarray  # first and last + 1 character in the text
    end: np.ndarray
    script: np.ndarray
    grams: list[np.ndarray]  # per kind: the bucket of each letter's n-gram
    first: np.ndarray  # each word's first place in ``grams``
    ptr: np.ndarray  # each text's first word, and the number of words


def words_of(texts: list[str]) -> Words:
    letter, lower, script = _tables()
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    begin = np.cumsum(size) - size

    def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = script[cp[at]]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (s[1:] != s[:-1])
        return new, np.flatnonzero(new)

    kind = letter[cp]
    at = np.flatnonzero(kind)
    new, first = runs(at)
    if len(at):  # marks alone are no word
        at = at[(np.maximum.reduceat(kind[at], first) == 2)[np.cumsum(new) - 1]]
        new, first = runs(at)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, [none] * KINDS, none, np.zeros(len(texts) + 1, np.int64))
    s = script[cp[at]]
    last = np.append(first[1:], len(at)) - 1
    word = np.cumsum(new) - 1
    # one zero before and behind every word, so that n-grams know its ends
    v = np.zeros(len(at) + len(first) + 3, np.uint64)
    place = np.arange(len(at)) + word + 1
    v[place] = lower[cp[at]]
    a, b, c, d = v[place - 1], v[place], v[place + 1], v[place + 2]
    d = np.where(c == 0, np.uint64(0), d)  # not the next word's letter
    mul = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier mixes all bits upwards
    h3 = ((a * np.uint64(0x1F3D5B79) + b) * mul + c) * mul
    h4 = ((h3 >> np.uint64(17)) ^ (h3 + d)) * mul
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    doc = np.searchsorted(begin, at[first], side="right") - 1
    return Words(doc, at[first] - begin[doc], at[last] + 1 - begin[doc], s[first],
                 [(h3 >> shift).astype(np.int64), (h4 >> shift).astype(np.int64)], first,
                 np.searchsorted(doc, np.arange(len(texts) + 1)))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # kind, bucket, language
    written: np.ndarray  # script, language: whether the language uses it
    penalty: float

    def scores(self, w: Words) -> np.ndarray:
        total = self.logp[0][w.grams[0]]
        for k in range(1, KINDS):
            total += self.logp[k][w.grams[k]]
        per = np.add.reduceat(total, w.first, axis=0) if len(w.first) else np.zeros((0, len(self.langs)), np.float32)
        return np.where(self.written[w.script], per, per + np.float32(NOT_WRITTEN_SO))


def viterbi(scores: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word of every text, a switch between neighbours costing ``penalty``.

    A block of words is a matrix: the best score from each label before it to each
    label at its end. The matrices of all blocks of a batch are computed in one
    lockstep, so a long text takes as many steps as it has blocks, not words.
    """
    n_words, k = scores.shape
    if not n_words:
        return np.zeros(0, np.int64)
    p = np.float32(penalty)
    count = np.diff(ptr)
    blocks = -(-count // BLOCK)
    b0 = np.cumsum(blocks) - blocks
    within = np.arange(n_words) - np.repeat(ptr[:-1], count)
    row, col = np.repeat(b0, count) + within // BLOCK, within % BLOCK
    part = np.zeros((int(blocks.sum()), BLOCK, k), np.float32)  # zeros behind a text's end change nothing
    part[row, col] = scores
    step = np.full((len(part), k, k), -1e30, np.float32)
    step[:, np.arange(k), np.arange(k)] = 0
    for t in range(BLOCK):
        np.maximum(step, step.max(2, keepdims=True) - p, out=step)
        step += part[:, t, None, :]

    order = np.argsort(-blocks, kind="stable")
    order = order[:int((blocks > 0).sum())]
    active = [int(x) for x in np.searchsorted(-blocks[order], -np.arange(int(blocks.max())), side="left")]  # texts with more than i blocks
    before = np.zeros((len(part), k))
    now = np.zeros((len(order), k))
    for i, n in enumerate(active):
        at = b0[order[:n]] + i
        before[at] = now[:n]
        got = (now[:n, :, None] + step[at]).max(1)
        now[:n] = got - got.max(1, keepdims=True)
    end = now.argmax(1)
    into, outof = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for i in range(len(active) - 1, -1, -1):
        n = active[i]
        at = b0[order[:n]] + i
        outof[at] = end[:n]
        into[at] = end[:n] = (before[at] + step[at, :, end[:n]]).argmax(1)

    every = np.arange(len(part))
    v = np.full((len(part), k), -1e30, np.float32)
    v[every, into] = 0
    back = np.zeros((BLOCK, len(part), k), np.int8 if k < 128 else np.int32)
    for t in range(BLOCK):
        best = v.argmax(1)
        top = v[every, best][:, None] - p
        back[t] = np.where(v >= top, np.arange(k), best[:, None])
        v = np.maximum(v, top) + part[:, t]
    label = np.zeros((len(part), BLOCK), np.int64)
    cur = outof
    for t in range(BLOCK - 1, -1, -1):
        label[:, t] = cur
        cur = back[t][every, cur]
    return label[row, col]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in blocks of ``BATCH_CHARS`` characters, the last text of each whole."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _fit_counts(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and language: the counts of n-grams (kind >= 0) and of letters per script (kind -1)."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for lang in set(langs):
                got = sums.setdefault(lang, np.zeros(KINDS * buckets + len(SCRIPT_NAMES), np.int64))
                for part in _blocks([t or "" for t, x in zip(texts, langs, strict=True) if x == lang]):
                    w = words_of(part)
                    for k in range(KINDS):
                        got[k * buckets:(k + 1) * buckets] += np.bincount(w.grams[k], minlength=buckets)
                    got[KINDS * buckets:] += np.bincount(w.script, w.end - w.start, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(got[at], pa.int64())],
                                             names=["lang", "feature", "n"])
    return count


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id",
        rows_per_label: int = 2000, penalty: float = 20.0) -> Model:
    """Learn from a bounded sample: about ``rows_per_label`` rows of each non-null label.

    The rows are chosen by a hash of ``key_col``, so the sample is spread over the whole
    table and a retry takes the same rows. Counting is distributed; the driver gets sums
    per label and bucket only.
    """
    rows = bounded_batches(labelled, "4m").where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = dict(rows.groupBy(label_col).count().collect())  # one row per label
    if not sizes:
        return Model([], np.zeros((KINDS, BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), penalty)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_label / n))])
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col(key_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(u < share[F.col(label_col)]).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    got = (sample.mapInArrow(_fit_counts(BUCKETS), "lang string, feature long, n long")
           .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())  # labels x buckets
    langs = sorted(sizes)
    table = np.zeros((KINDS * BUCKETS + len(SCRIPT_NAMES), len(langs)))
    table[got["feature"], got["lang"].map({x: i for i, x in enumerate(langs)})] = got["n"]
    scripts = table[KINDS * BUCKETS:]
    written = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    written[~written.any(1)] = True  # a script that no language uses rules out none
    grams = table[:KINDS * BUCKETS].reshape(KINDS, BUCKETS, len(langs)) + 0.05
    return Model(langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), written, penalty)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def label_batch(texts: list[str], model: Model) -> tuple[list, np.ndarray, pa.ListArray]:
    """Language, score and spans of each text of a batch."""
    w = words_of(texts)
    k = max(len(model.langs), 1)
    names = np.array([*model.langs, UNDETERMINED], dtype=object)
    if model.langs:
        label = viterbi(model.scores(w), w.ptr, model.penalty)
    else:
        label = np.zeros(len(w.doc), np.int64)  # names[0] is then "und"
    letters = np.bincount(w.doc * k + label, w.end - w.start, len(texts) * k).reshape(len(texts), k)
    total = letters.sum(1)
    best = np.where(total > 0, letters.argmax(1), len(model.langs))
    score = np.where((total > 0) & bool(model.langs), letters.max(1) / np.maximum(total, 1), 0.0)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(label)) - 1 if len(first) else first
    spans = pa.StructArray.from_arrays([pa.array(w.start[first], pa.int32()), pa.array(w.end[last], pa.int32()),
                                        pa.array(names[label[first]].tolist(), pa.string())], names=["start", "end", "lang"])
    offsets = np.searchsorted(w.doc[first], np.arange(len(texts) + 1)).astype(np.int32)
    return names[best].tolist(), score, pa.ListArray.from_arrays(pa.array(offsets), spans)


def language(text: Column, model: Model) -> Column:
    """Struct of ``lang``, ``score`` (share of the letters in it, 0 to 1) and ``spans``.

    Spans are (start, end, lang) in characters, in order, over all words of the text. A
    null text and one without letters have the language ``und``, score 0 and no spans.
    """

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts, texts, chars = [], [], 0
            for x in column:
                texts.append(x.as_py() or "")
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    parts.append(label_batch(texts, model))
                    texts, chars = [], 0
            parts.append(label_batch(texts, model))
            yield pa.StructArray.from_arrays([pa.array([x for p in parts for x in p[0]], pa.string()),
                                              pa.array(np.concatenate([p[1] for p in parts]), pa.float64()),
                                              pa.concat_arrays([p[2] for p in parts])], names=["lang", "score", "spans"])

    return label.asNondeterministic()(text)  # so that the optimizer keeps it to one evaluation


def with_language(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct of ``language`` added as ``out`` (an existing one is replaced).

    Reads the text only. Repeated rows are labelled alike; an empty table gives an empty
    result.
    """
    return bounded_batches(docs, "4m").withColumn(out, language(F.col(text_col), model))
