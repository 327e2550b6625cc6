"""Exact dedup: 128-bit content hash, one row stays per text, bytes compared.

Only DataFrame functions. Copies meet as one partial row per task (``min``/``max``
of the text combine before the shuffle), so a text that a third of all rows share
never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min") -> DataFrame:
    """One row per distinct text: ``hash``, ``sha``, ``keep_id``, ``group_size``.

    ``hash`` is the 128-bit MD5 of the text and groups the rows. Inside a group the
    smallest and the largest text are compared byte by byte: equal ends mean equal
    texts. A group whose ends differ (a hash collision) is split by the text itself.

    ``keep``: ``min`` or ``max`` id stays. A null text counts as the empty text. A
    null id never stays while another id of the group is not null.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.md5("text"))
    groups = written(
        rows.groupBy("hash").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                 F.min("text").alias("lo"), F.max("text").alias("hi"))
        .select("hash", F.sha2("lo", 256).alias("sha"), "keep_id", "group_size", (F.col("lo") == F.col("hi")).alias("same")),
        "copy-groups")
    clean = groups.where("same").drop("same")
    collided = groups.where(~F.col("same")).select("hash")
    if collided.isEmpty():
        return clean
    split = (rows.join(collided, "hash", "left_semi").groupBy("hash", "text")
             .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
             .select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    return clean.unionByName(split)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min") -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` added.

    Columns of those names in ``docs`` are replaced. Rows that repeat the same id and
    text are one document: each of them carries the same marks. An empty table gives
    an empty result. Long texts are hashed whole.
    """
    groups = copy_groups(docs, id_col, text_col, keep)
    out = docs.drop(*[c for c in ("keep_id", "group_size", "kept", "text_sha256") if c in docs.columns])
    h, sha = fresh(out, "hash"), "text_sha256"
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = out.withColumns({h: F.md5(text), sha: F.sha2(text, 256)})
    g = groups.select(F.col("hash").alias("g_hash"), F.col("sha").alias("g_sha"), "keep_id", "group_size")
    return (out.join(g, (out[h] == g["g_hash"]) & (out[sha] == g["g_sha"]), "left")
            .drop(h, "g_hash", "g_sha")
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min") -> DataFrame:
    """``docs`` without the rows that are not the staying copy; its columns unchanged."""
    return mark_copies(docs, id_col, text_col, keep).where("kept").select(*docs.columns)
