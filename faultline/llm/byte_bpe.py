"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate up the tree.

``encode(x + y)`` follows from ``encode(x)`` and ``encode(y)`` by encoding a window around
the cut anew. The window is grown until the tokens outside provably stay:

* A safe boundary is a place where the split pattern ends a match whatever stands
  farther away: before white space that follows other text, and where letters, digits
  and other marks meet (but not behind an apostrophe, which can begin a contraction).
  Matches are encoded separately, so tokens before and behind a safe boundary do not
  depend on each other. The window reaches to the nearest one on either side.
* Inside one long match (a run of letters without a break) there is none. There the
  window is counted in tokens and doubled until each outer token and its new neighbour
  are the encoding of their own joined bytes. A sequence whose neighbours all pass that
  test is the encoding of the whole: no merge can reach over any of its borders.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches

LEAF_CHARS = 1024
LEAF_IDS = 4096
LONG_REGION = 4096

SAFE = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\p{Cn}])|(?<=\p{N})(?=[^\p{N}\p{Cn}])|(?<=[^\s\p{L}\p{N}\p{Cn}'])(?=[\s\p{L}\p{N}])")
ONE_MATCH = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}\p{Cn}]+)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class TreeBpe:
    """Encoder and decoder of one rank file; ``leaf_chars`` is the size that is encoded at once."""

    def __init__(self, ranks_file: str, pattern: str, leaf_chars: int = LEAF_CHARS, long_region: int = LONG_REGION):
        import tiktoken

        ranks = load_ranks(ranks_file)
        self.lib = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=0) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.leaf, self.long = leaf_chars, long_region

    # encoding

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.lib.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        p, q = self._before(text, lo, mid), self._behind(text, mid, hi)
        if q - p > self.long and ONE_MATCH.fullmatch(text, p, q):
            return self._join_inside(left, right, len(text[p:mid].encode()), len(text[mid:q].encode()))
        n, m = self._span(reversed(left), len(text[p:mid].encode())), self._span(right, len(text[mid:q].encode()))
        if n:
            del left[-n:]
        left += self.lib.encode_ordinary(text[p:q])
        left += right[m:]
        return left

    def _span(self, ids, size: int) -> int:
        """How many ids make up ``size`` bytes."""
        n, ids = 0, iter(ids)
        while size > 0:
            size -= len(self.bytes[next(ids)])
            n += 1
        assert size == 0, "a safe boundary is a token boundary"
        return n

    @staticmethod
    def _before(text: str, lo: int, mid: int) -> int:
        """The last safe boundary in [lo, mid], or ``lo``."""
        p = text.rfind(" ", lo + 1, mid)
        if p > 0 and text[p - 1].isalnum() and mid - p < 64:
            return p
        width = 64
        while True:
            at = max(lo, mid - width)
            # one character on each side decides, and both must lie in the left half
            found = [m.start() for m in SAFE.finditer(text, max(lo, at - 1), mid) if at < m.start() < mid]
            if found:
                return found[-1]
            if at == lo:
                return lo
            width *= 4

    @staticmethod
    def _behind(text: str, mid: int, hi: int) -> int:
        """The first safe boundary in (mid, hi], or ``hi``."""
        q = text.find(" ", mid + 1, min(hi, mid + 64))
        if q > 0 and text[q - 1].isalnum():
            return q
        width = 64
        while True:
            to = min(hi, mid + width)
            for m in SAFE.finditer(text, mid, min(hi, to + 1)):
                if mid < m.start() < hi:
                    return m.start()
            if to == hi:
                return hi
            width *= 4

    def _join_inside(self, left: list[int], right: list[int], left_size: int, right_size: int) -> list[int]:
        """Join two parts of one match: only the last ``left_size`` and first ``right_size`` bytes belong to it."""
        n, m = self._span(reversed(left), left_size), self._span(right, right_size)
        k = 4
        while True:
            a, b = min(k, n), min(k, m)
            part = b"".join([self.bytes[i] for i in left[len(left) - a:]] + [self.bytes[i] for i in right[:b]])
            new = self.lib._encode_single_piece(part)
            if (a == n or self._stays(left[-a - 1], new[0])) and (b == m or self._stays(new[-1], right[b])):
                return left[:len(left) - a] + new + right[b:]
            k *= 2

    def _stays(self, a: int, b: int) -> bool:
        return self.lib._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    # decoding

    def decode(self, ids) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids, lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_IDS:
            return b"".join([self.bytes[i] for i in ids[lo:hi]])
        mid = (lo + hi) // 2
        return self._decode(ids, lo, mid) + self._decode(ids, mid, hi)


def encode(text: Column, ranks_file: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> Column:
    """The token ids of a text: those of each match of ``pattern``, without special tokens.

    ``ranks_file`` lies at the same path on every executor. A null text is encoded as
    the empty one (no ids); bytes that are no UTF-8 count as U+FFFD.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = TreeBpe(ranks_file, pattern, leaf_chars)
        for texts in batches:
            raw = texts.cast(pa.binary())
            offsets, out = [0], []
            for x in raw:
                b = x.as_py()
                out.append(pa.array(bpe.encode(b.decode("utf-8", "replace")) if b else [], pa.int32()))
                offsets.append(offsets[-1] + len(out[-1]))
            values = pa.concat_arrays(out) if out else pa.array([], pa.int32())
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return ids_of.asNondeterministic()(text)  # so that the optimizer keeps it to one evaluation


def decode(ids: Column, ranks_file: str, pattern: str) -> Column:
    """The bytes of token ids; null ids decode to no bytes."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = TreeBpe(ranks_file, pattern)
        for lists in batches:
            yield pa.array([bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in lists], pa.binary())

    return bytes_of(ids)


def encode_table(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary) added.

    Every row is encoded by itself, repeated rows too; columns of the two names are
    replaced; an empty table gives an empty result.
    """
    out = bounded_batches(docs, "4m").drop(*[c for c in ("ids", "decoded") if c in docs.columns])
    out = out.withColumn("ids", encode(F.col(text_col), ranks_file, pattern))
    return out.withColumn("decoded", decode(F.col("ids"), ranks_file, pattern))


def with_digests(encoded: DataFrame) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` (of the decimal ids, one space between) and ``decoded_sha256``."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2("decoded", 256)})
