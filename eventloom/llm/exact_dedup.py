"""Exact deduplication of texts.

Texts are the same when their bytes are the same after lower-casing A-Z. Grouping is by
a 128-bit hash and, within it, by the bytes themselves, so two texts that collide form
two groups. Partial aggregation folds the copies that a task holds before the shuffle:
a text that makes up a third of all rows arrives as one row per task. Rows find their
group again by slim digests, never by the text.

Defined results: a null text counts as empty; the kept row is the one with the smallest
(`keep="min"`) or largest (`keep="max"`) id, nulls losing to any id; rows that repeat
both id and text share the decision in `group_copies`, while `drop_copies` leaves one
of them; an empty table gives an empty result; extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import ascii_lower, checkpoint, text_or_empty


def _classes(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """One row per distinct text: both digests, the id that stays, the number of rows."""
    pick = {"min": F.min, "max": F.max}[keep]
    normal = ascii_lower(text_or_empty(text_col)).alias("content")
    return (
        docs.select(F.col(id_col).alias("doc_id"), normal)
        .select("doc_id", "content", F.md5("content").alias("hash128"))
        .groupBy("hash128", "content")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash128", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept and text_sha256."""
    classes = checkpoint(_classes(docs, id_col, text_col, keep))
    normal = ascii_lower(text_or_empty(text_col)).alias("content")
    rows = docs.select(F.col(id_col).alias("doc_id"), normal).select(
        "doc_id", F.md5("content").alias("hash128"), F.sha2("content", 256).alias("text_sha256")
    )
    return rows.join(classes, ["hash128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of `docs` that stay, columns unchanged."""

    def row_key(text_hash, doc_id):
        return F.md5(F.concat(text_hash, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))

    kept = checkpoint(
        _classes(docs, id_col, text_col, keep).select(row_key(F.col("hash128"), F.col("keep_id")).alias("row_key"))
    )
    keyed = docs.select(
        F.struct("*").alias("row"),
        row_key(F.md5(ascii_lower(text_or_empty(text_col))), F.col(id_col)).alias("row_key"),
    )
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
