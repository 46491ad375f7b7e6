"""Bounded, deterministic samples of labelled and unlabelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this (bytes) aren't used for fitting; scoring takes whole texts of any length.
FIT_BYTES = 32_000


def thinned(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` of the rows, picked by the hash of ``key``, at most twice as many; all, if there are fewer.

    A count fixes the rate: no sort, and no partition sends more than its share."""
    n = rows.count()
    if n <= limit:
        return rows
    spot = F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 31))
    return rows.where(spot < int((1 << 31) * limit / n)).limit(2 * limit)


def labelled(docs: DataFrame, labels: DataFrame, label: str, value: int, limit: int, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of about ``limit`` documents that ``labels`` marks with ``value``. Ids with both values, null ids
    and null labels are left out; a repeated document counts once."""
    marks = labels.where(F.col(doc_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_col).alias("doc_id")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    ids = thinned(marks.where((F.col("a") == value) & (F.col("b") == value)).select("doc_id"), "doc_id", limit)
    return texts_of(docs, ids, doc_col, text_col)


def texts_of(docs: DataFrame, ids: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the few documents in ``ids`` (a bounded sample, hence the broadcast)."""
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(ids), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))
