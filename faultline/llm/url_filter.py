"""URL filter: a blocked Bloom filter in front of an exact join with the listed URLs.

Only DataFrame functions. The list holds canonical URL prefixes (``host`` + ``path``),
each with a verdict. A URL's candidates are its host suffixes and path prefixes of the
shapes that occur in the list; the filter drops nearly all of them before any shuffle,
and the join on the canonical text removes what passed by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, written

WORDS = 8  # 64-bit words per block: one bit is set in each
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17  # 72 bytes each with its number: under 10 MB, whatever the list


def with_host_path(df: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """Add the host (after the first ``://``, A-Z lower-cased) and the path (up to ``?`` or ``#``).

    Both are empty for a null URL and for one without ``://``.
    """
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({host: ascii_lower(F.regexp_extract(url, parts, 1)), path: F.regexp_extract(url, parts, 2)})


def _bit(i: int) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * i}) & 63 AS int))"


def _hashed(df: DataFrame, n_blocks: int) -> DataFrame:
    return df.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"),
                           "bits": F.xxhash64(F.lit(1), F.col("key"))})


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: one row of eight words per block that holds a key."""
    return _hashed(keys, n_blocks).groupBy("block").agg(*[F.expr(f"bit_or({_bit(i)})").alias(f"w{i}") for i in range(WORDS)])


def block_count(n_keys: int) -> int:
    return min(MAX_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS))))


def maybe_listed(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates whose eight bits are all set in their block: all listed ones, few others.

    The broadcast side has at most ``MAX_BLOCKS`` rows of fixed width.
    """
    probe = _hashed(candidates, n_blocks).join(F.broadcast(blocks), "block")
    for i in range(WORDS):
        probe = probe.where(F.expr(f"(w{i} & {_bit(i)}) != 0"))
    return probe.select(*candidates.columns)


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added.

    ``listed``: ``host``, ``path``, ``verdict``. An entry fits its host and all its
    subdomains if the URL's path starts with the entry's path; the longest entry (host
    and path together, then the greater text) wins. Without one, ``rule`` is null and
    ``verdict`` is ``default``: the URL is not listed.

    Null and malformed URLs have an empty host and path and fit no entry. Repeated
    URLs are judged once. Columns of the four names in ``pages`` are replaced; an empty
    table or an empty list needs no special case. Entries that repeat a host and path:
    the smallest verdict counts.
    """
    entries = (listed.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
               .groupBy("host", "path").agg(F.min("verdict").alias("verdict"), F.count(F.lit(1)).alias("n")).where("host != ''")
               .select(F.concat("host", "path").alias("key"), "verdict",
                       F.size(F.split("host", "[.]", -1)).alias("labels"), F.length("path").alias("chars")))
    shapes = [tuple(r) for r in entries.select("labels", "chars").distinct().collect()]  # kinds of entries, not entries
    out = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns])
    out = with_host_path(out, url_col)
    if not shapes:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n_blocks = block_count(entries.count())
    blocks = bloom_blocks(entries.select("key"), n_blocks)

    urls = with_host_path(pages.select(F.col(url_col).alias("url")).distinct(), "url")
    n_labels = F.size(F.split("host", "[.]", -1))
    options = [F.when((n_labels >= labels) & (F.length("path") >= chars),
                      F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))
               for labels, chars in sorted(shapes)]
    candidates = urls.select("url", F.explode(F.array_compact(F.array(*options))).alias("key"))
    found = (maybe_listed(candidates, blocks, n_blocks)
             .join(entries.select("key", F.col("verdict").alias("said")), "key")
             .groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("said"))).alias("best"))
             .select(F.col("url").alias("found_url"), "best"))
    found = written(found, "url-verdicts", free=False)  # so that the join can split the pages of one URL over many tasks
    u, b = fresh(out, "found_url"), fresh(out, "best")
    found = found.select(F.col("found_url").alias(u), F.col("best").alias(b))
    return (out.join(found, out[url_col] == found[u], "left")
            .withColumns({"rule": F.col(f"{b}.key"), "verdict": F.coalesce(F.col(f"{b}.said"), F.lit(default))})
            .drop(u, b))


def drop_blocked(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` without the rows whose verdict is ``block``; its columns unchanged."""
    marks = judge_urls(pages.select(F.col(url_col).alias("url")).distinct(), listed, "url")
    blocked = marks.where("verdict = 'block'").select(F.col("url").alias("_blocked_url"))
    return pages.join(blocked, pages[url_col] == blocked["_blocked_url"], "left_anti")
