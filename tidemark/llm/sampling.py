"""Folds and bounded labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int, which: int) -> Column:
    """Whether crc32 of the key as text has that remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == which, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(label, text) of at most max_rows labelled keys, those whose hash is smallest.

    Only the chosen keys, of a size that max_rows bounds, are broadcast; the texts are not shuffled. Rows with a
    null key, label or text are left out, and a key with several labels counts with the largest.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(max_rows)
    )
    body = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return body.join(F.broadcast(chosen), "__key").select("label", "text")
