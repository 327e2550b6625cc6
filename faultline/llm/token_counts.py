"""Token counts by the tokenizers library: Arrow batches in, lengths out."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

BATCH_BYTES = 16 << 20
CALL_PIECES = 20_000


def byte_batches(texts: pa.Array, batch_bytes: int) -> Iterator[pa.Array]:
    """Slices of about ``batch_bytes`` each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + batch_bytes, side="right")))
        yield texts.slice(at, to - at)
        at = to


def piece_counts(pieces: list[str], encode_batch) -> np.ndarray:
    """Tokens of each piece, a bounded number of them per call of the library."""
    out = np.zeros(len(pieces), "int64")
    for i in range(0, len(pieces), CALL_PIECES):
        out[i:i + CALL_PIECES] = [len(e) for e in encode_batch(pieces[i:i + CALL_PIECES], add_special_tokens=False)]
    return out


def batch_counts(texts: pa.Array, encode_batch) -> np.ndarray:
    """Tokens of each text of one batch.

    Every text is cut at its ASCII white space. These cuts are safe for a vocabulary
    whose split pattern drops white space: no match, no merge, no special token and no
    Unicode composition reaches over one. So the count of a text is the sum over its
    pieces, however long it is, and a piece that a batch holds many times is encoded once.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    pieces = words.flatten().dictionary_encode()
    per = piece_counts(pieces.dictionary.to_pylist(), encode_batch)
    upto = np.concatenate([[0], np.cumsum(per[pieces.indices.to_numpy(zero_copy_only=False)])])
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


def token_count(text: Column, tokenizer_file: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """The number of tokens of a text; null and empty texts have none.

    ``tokenizer_file``: a ``.json`` of the tokenizers library, at the same path on
    every executor. Its pre-tokenizer must drop white space (see ``batch_counts``).
    No special tokens are added; their strings inside texts count as the library's
    default has it. No truncation, no padding.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        t.no_truncation()
        t.no_padding()
        for texts in batches:
            got = [batch_counts(x, t.encode_batch_fast) for x in byte_batches(texts, batch_bytes)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0, "int64"), pa.int64())

    return count(text)


def with_token_counts(docs: DataFrame, tokenizer_file: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null text counts as empty. Every row is counted by itself, repeated rows too; an
    empty table gives an empty result. Columns of the three names are replaced.
    """
    out = bounded_batches(docs).drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c in docs.columns])
    out = out.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"),
                           "n_tokens": token_count(F.col(text_col), tokenizer_file)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
