"""Key-based upsert, in-batch dedupe, referential checks.

Upsert = ``target LEFT ANTI source_keys  UNION ALL  source``: one shuffle on
the key (or none when AQE sees a small source and broadcasts its keys).
Dedupe keeps the last arrival per key with ``max_by`` -- a partial
aggregate, so a key repeated a billion times is reduced map-side instead of
being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A key occurs twice in one upsert batch (the database rejects the batch)."""


def dedupe_last(df: DataFrame, key: str | list[str], order: list[str], null_is_key: bool = False) -> DataFrame:
    """Keep the last row per key by ``order`` (ascending arrival).

    ``order`` must be unique within a key; rows that tie keep any one of them.
    Null keys never match each other, so they are all kept -- unless
    ``null_is_key`` (a table of counters has one row for the null key).
    """
    cols, keys = [c for c in df.columns], [key] if isinstance(key, str) else key
    packed = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order])
    if null_is_key:
        return df.groupBy(*keys).agg(F.max_by(packed, rank).alias("_row")).select("_row.*")
    # one aggregate and one read: a null key is told apart by a value of its own
    null = F.col(keys[0]).isNull()
    alone = F.when(null, F.expr("uuid()"))
    return df.groupBy(*keys, alone.alias("_alone")).agg(F.max_by(packed, rank).alias("_row")).select("_row.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once in a batch."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def upsert(target: DataFrame, source: DataFrame, key: str, on_duplicate: str = "error",
           order: list[str] | None = None) -> DataFrame:
    """Full-row replace by key; new keys appended.

    ``on_duplicate='error'`` fails the batch when a key repeats (checked
    with one bounded action: ``limit(1)`` of the duplicate keys);
    ``'last'`` keeps the last arrival by ``order``.
    """
    if on_duplicate == "last":
        if not order:
            raise ValueError("on_duplicate='last' needs an arrival order")
        src = dedupe_last(source, key, order).select(*target.columns)
    elif on_duplicate == "error":
        dup = duplicate_keys(source, key).limit(1).collect()
        if dup:
            raise DuplicateKeyError(f"key {dup[0][key]!r} occurs more than once in the batch")
        src = source.select(*target.columns)
    else:
        raise ValueError(on_duplicate)
    keys = source.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    kept = target.join(keys, target[key] == keys["_k"], "left_anti")
    return kept.unionByName(src)


def upsert_summary(target: DataFrame, source: DataFrame, key: str, written: DataFrame | None = None) -> DataFrame:
    """Sent / written / inserted / updated counts of one upsert batch.

    ``written`` is the deduplicated batch (defaults to ``source``). One join
    of the written keys with the target keys, then one aggregate row.
    """
    w = (written if written is not None else source).select(F.col(key).alias("_k"))
    tk = target.select(F.col(key).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    j = w.join(tk, w["_k"] == tk["_t"], "left")
    summary = j.agg(
        F.count(F.lit(1)).alias("uploaded"),
        F.count_if(F.col("_t").isNull()).alias("inserted"),
        F.count_if(F.col("_t").isNotNull()).alias("updated"),
    )
    return summary.select(source.agg(F.count(F.lit(1))).scalar().alias("total_sent"),
                          "uploaded", "inserted", "updated")


def upsert_counted(target: DataFrame, source: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """K5 + K10 in one join: the merged rows with the columns that the counts of the batch need, and these counts.

    The last arrival of a key by ``order`` replaces the row of the target (whose
    keys are unique) or is added; null keys match nothing and are all kept. To be
    aggregated over the merged rows: ``total_sent``, ``uploaded``, ``inserted``, ``updated``.
    """
    cols = target.columns
    alone = F.when(F.col(key).isNull(), F.expr("uuid()"))
    new = source.groupBy(key, alone.alias("_alone")).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"), F.count(F.lit(1)).alias("_sent"))
    old = target.select(F.col(key).alias("_key"), F.struct(*cols).alias("_old"))
    both = old.join(new, F.col("_key") == F.col(key), "full")
    row = F.coalesce("_new", "_old")
    merged = both.select(*[row[c].alias(c) for c in cols], "_sent", F.col("_old").isNotNull().alias("_had"))
    sent = F.col("_sent").isNotNull()
    return merged, {"total_sent": F.sum("_sent"), "uploaded": F.count_if(sent), "inserted": F.count_if(sent & ~F.col("_had")),
                    "updated": F.count_if(sent & F.col("_had"))}


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose (non-null) foreign key has no parent row."""
    keys = parent.select(F.col(pk).alias("_pk"))
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """``ON DELETE CASCADE`` -- the child rows that survive the delete."""
    keys = deleted_parents.select(F.col(pk).alias("_pk"))
    return child.join(keys, F.col(fk) == F.col("_pk"), "left_anti")
