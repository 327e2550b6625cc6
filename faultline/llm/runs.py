"""Periodic runs of words by recompression.

Rounds of block and pair compression turn the words of a batch of texts into a run-length
grammar; equal pieces get equal names in every round. Two positions are compared by
climbing the rounds while the names agree and descending from where they do not, which
answers how far they agree without a suffix array. Positions a period apart on the grid
of its multiples are the candidates; what they extend to on both sides is a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

MIN_LENGTH = 12
BATCH_BYTES = 2 << 20
RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Round(NamedTuple):
    """The names of one round, and how the next one gathers them."""

    name: np.ndarray
    up: np.ndarray  # of each name: its place in the next round
    begin: np.ndarray  # of each place of the next round: its first name here; one more at the end
    block: bool  # blocks of one name, or pairs


def _bits(s: np.ndarray, turn: int) -> np.ndarray:
    """A bit of each name, drawn anew in each turn."""
    h = (s.view(np.uint64) ^ (np.uint64(turn) << np.uint64(40))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX2 >> np.uint64(63)


def grammar(s: np.ndarray) -> list[Round]:
    """The rounds over ``s``: names of 0 or more, between separators below 0 that occur once each.

    Alternately, blocks of one name and pairs of a left and a right name become new names;
    the sides are drawn by hash in every round. The last round holds no two names side by side.
    """
    rounds, block, fresh, turn = [], True, int(s.max(initial=-1)) + 1, 0
    while ((s[1:] >= 0) & (s[:-1] >= 0)).any():
        head = np.ones(len(s), bool)
        if block:
            head[1:] = s[1:] != s[:-1]
        else:
            left = _bits(s, turn) == 0
            head[1:] = ~((s[1:] >= 0) & (s[:-1] >= 0) & left[:-1] & ~left[1:])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(s)))
        many = np.flatnonzero(size > 1)
        if len(many):
            second = size[many] if block else s[begin[many] + 1]
            pairs, ids = np.unique(s[begin[many]] * (int(second.max()) + 1) + second, return_inverse=True)
            names = s[begin].copy()
            names[many] = fresh + ids
            fresh += len(pairs)
            rounds.append(Round(s, np.cumsum(head) - 1, np.append(begin, len(s)), block))
            s = names
        block, turn = not block, turn + 1
    none = np.zeros(0, np.int64)
    return [*rounds, Round(s, none, none, False)]


def extensions(rounds: list[Round], x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many names agree from ``x`` and ``y`` on (``step`` 1) or before them (``step`` -1), x != y."""

    def jump(r: Round, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal names that can be passed at once."""
        if not r.block or not len(r.up):
            return np.ones(len(a), np.int64)
        if step > 0:
            return np.minimum(r.begin[r.up[a] + 1] - a, r.begin[r.up[b] + 1] - b)
        return np.minimum(a - r.begin[r.up[a]], b - r.begin[r.up[b]]) + 1

    def at_edge(r: Round, a: np.ndarray) -> np.ndarray:
        return r.begin[r.up[a]] == a if step > 0 else r.begin[r.up[a] + 1] - 1 == a

    back = int(step < 0)
    a, b, who = x - back, y - back, np.arange(len(x))
    stopped = []
    for r in rounds:
        climb = r.name[a] == r.name[b]
        if len(r.up):
            inside = np.flatnonzero(climb)
            edge = at_edge(r, a[inside]) & at_edge(r, b[inside])
            pass_ = inside[~edge]
            m = jump(r, a[pass_], b[pass_]) * step
            a[pass_] += m
            b[pass_] += m
            climb[pass_] = at_edge(r, a[pass_]) & at_edge(r, b[pass_])
        else:
            climb[:] = False
        stopped.append((a[~climb], b[~climb], who[~climb]))
        if not climb.any():
            break
        a, b, who = r.up[a[climb]], r.up[b[climb]], who[climb]
    a = b = who = np.zeros(0, np.int64)
    for k in range(len(stopped) - 1, -1, -1):
        r = rounds[k]
        if len(a):  # what has come down: the names inside the two that differ
            a, b = (r.begin[a], r.begin[b]) if step > 0 else (r.begin[a + 1] - 1, r.begin[b + 1] - 1)
        a, b, who = (np.concatenate(p) for p in zip((a, b, who), stopped[k], strict=True))
        on = np.flatnonzero(r.name[a] == r.name[b])
        while len(on):
            m = jump(r, a[on], b[on]) * step
            a[on] += m
            b[on] += m
            on = on[r.name[a[on]] == r.name[b[on]]]
    out = np.empty(len(x), np.int64)
    out[who] = (a - x[who]) if step > 0 else (x[who] - 1 - a)
    return out


def runs_of(s: np.ndarray, text: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs, by start and period.

    ``s``: names between separators, as ``grammar`` takes them; ``text``: the text of each
    place; ``longest``: the words of the longest text. A run is at least ``min_length``
    and two periods long; its period is its smallest one, and no neighbour extends it.
    """
    at, period = [], []
    for q in range(1, longest // 2 + 1):  # a run of period q holds a multiple of q and the place q after it
        grid = s[::q]
        i = np.flatnonzero(grid[1:] == grid[:-1]) * q
        if len(i):
            at.append(i)
            period.append(np.full(len(i), q))
    i, q = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (at, period))
    same = text[i] == text[i + q]
    i, q = i[same], q[same]
    rounds = grammar(s)
    after, before = extensions(rounds, i, i + q, 1), extensions(rounds, i, i + q, -1)
    long = (after + before >= q) & (after + before + q >= min_length)
    start, end, q = (i - before)[long], (i + q + after)[long], q[long]
    order = np.lexsort((q, end, start))  # a multiple of a run's period has the same ends
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs_batch(texts: pa.Array, min_length: int = MIN_LENGTH) -> pa.StructArray:
    """Words, runs and the text without the periods that repeat, of each text (string, no nulls)."""
    split = pc.ascii_split_whitespace(texts)  # at the six ASCII blanks only; blanks at the ends leave empty words
    word, of = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    filled = pc.not_equal(word, "")
    word, of = word.filter(filled), of[filled.to_numpy(zero_copy_only=False)]
    size = np.bincount(of, minlength=len(texts))
    place = np.arange(len(of)) + of + 1  # a separator before each text, and one at the end
    begin = np.cumsum(size + 1) - size
    s = np.empty(len(of) + len(texts) + 1, np.int64)
    s[np.append(begin - 1, len(s) - 1)] = -1 - np.arange(len(texts) + 1)
    s[place] = word.dictionary_encode().indices.to_numpy()
    text = np.repeat(np.arange(len(texts) + 1), np.append(size + 1, 1))
    start, end, period = runs_of(s, text, int(size.max(initial=0)), min_length)
    gone = np.zeros(len(s) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = (np.cumsum(gone) == 0)[place]
    lists = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    own = begin[text[start]]
    rows = pa.StructArray.from_arrays([start - own, end - start, period], names=["start", "length", "period"])
    collapsed = pa.ListArray.from_arrays(lists(np.bincount(of[kept], minlength=len(texts))), word.filter(pa.array(kept)))
    return pa.StructArray.from_arrays([size, pa.ListArray.from_arrays(lists(np.bincount(text[start], minlength=len(texts))), rows),
                                       pc.binary_join(collapsed, " ")], names=["n_words", "runs", "collapsed"])


def periodic_runs(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """Struct of ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``.

    Words are runs of other characters than the six ASCII blanks. ``collapsed``: the words
    that no run contains after its first period, joined by one space. A null or empty
    text has no words, no runs and collapses to the empty text.
    """

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            column, parts, lo = pc.fill_null(column, ""), [], 0
            upto = np.cumsum(pc.binary_length(column).to_numpy())
            while lo < len(column):  # pieces of BATCH_BYTES and one more text at most
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH_BYTES)) + 1
                parts.append(runs_batch(column.slice(lo, hi - lo), min_length))
                lo = hi
            yield pa.concat_arrays(parts) if parts else runs_batch(column, min_length)

    return run.asNondeterministic()(text)  # so that the optimizer keeps it to one evaluation


def with_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the struct of ``periodic_runs`` added as ``out`` (an existing column of the name is replaced).

    Each row is judged by its whole text alone: repeated rows give equal results, a text of
    any length is one piece of one task, and an empty table gives an empty result.
    """
    return bounded_batches(docs).withColumn(out, periodic_runs(F.col(text_col), min_length))
