"""Deduplication with provenance: one row per address, independent of the order in which observations came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import clean_title, flags
from tideline.functions.urls import article_id, canonical_url, date_in_url, without_tracking
from tideline.functions.values import parse_compact


def canonical(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A text that orders observations: the columns as JSON, names in order, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def first_filled(value: Column, order: Column) -> Column:
    """An aggregate: the value of the first row by ``order`` whose value is neither null nor empty; "" if there is none.
    It is kept as a pair, so that a hot group costs no more than others."""
    return F.coalesce(F.min_by(value, F.when(value.isNotNull() & (value != ""), order)), F.lit(""))


def _union(values: Column) -> Column:
    """An aggregate: the distinct values, none null or empty, in order."""
    return F.array_sort(F.collect_set(F.when(values != "", values)))


def clean_archive(records: DataFrame, hosts: Sequence[str], host: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Records (url, title, discovered_for_date, ...) with normalized_url, clean_title, publication_date, quality_flags
    and disposition: kept, quarantined (no valid address or date), or excluded (outside the range, ends included)."""
    url = canonical_url(F.col("url"), hosts, host)
    out = records.withColumn("normalized_url", url).withColumn("clean_title", clean_title(F.col("title")))
    out = out.withColumn("publication_date", date_in_url(F.col("normalized_url"))).withColumn("__found", F.col("discovered_for_date").try_cast("date"))
    day = F.col("publication_date")
    outside = F.lit(False) if start is None else F.coalesce(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    bad = F.col("normalized_url").isNull() | day.isNull()
    found = flags(
        ("invalid_url", F.col("normalized_url").isNull()), ("missing_url_publication_date", day.isNull()), ("missing_title", F.col("clean_title") == ""),
        ("invalid_discovery_date", F.col("__found").isNull()), ("url_date_differs_from_archive_date", day != F.col("__found")),
        ("publication_date_outside_requested_range", ~bad & outside),
    )
    return out.withColumn("quality_flags", found).withColumn("disposition", F.when(bad, "quarantined").when(outside, "excluded").otherwise("kept")).drop("__found")


def merge_archive(cleaned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per normalized_url of the kept records: each field is the first that is filled, in canonical order.
    provenance() has the observations."""
    kept = cleaned.where("disposition = 'kept'").withColumn("__o", canonical(cleaned, columns))
    o = F.col("__o")
    codes = kept.select("normalized_url", F.explode("quality_flags").alias("f")).groupBy("normalized_url").agg(F.array_sort(F.collect_set("f")).alias("quality_flags"))
    merged = kept.groupBy("normalized_url").agg(
        first_filled(F.col("url"), o).alias("original_url"), first_filled(F.col("clean_title"), o).alias("title"), F.min("publication_date").alias("publication_date"),
        _union(F.col("discovered_for_date").try_cast("date").cast("string")).alias("discovered_for_dates"), F.count("*").alias("source_record_count"),
    )
    merged = merged.join(codes, "normalized_url", "left").withColumn("quality_flags", F.coalesce("quality_flags", F.array().cast("array<string>")))
    return merged.select(article_id(F.col("normalized_url")).alias("article_id"), *merged.columns)


def provenance(cleaned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(article_id, record): every kept observation of each article, losslessly, as rows rather than one list."""
    kept = cleaned.where("disposition = 'kept'")
    return kept.select(article_id(F.col("normalized_url")).alias("article_id"), canonical(cleaned, columns).alias("record"))


def clean_feed(records: DataFrame) -> DataFrame:
    """Feed records (url, title, seendate, ...) with normalized_url, clean_title, seen_at, quality_flags and
    disposition (kept, or quarantined for an invalid address)."""
    out = records.withColumn("normalized_url", without_tracking(F.col("url"))).withColumn("clean_title", clean_title(F.col("title"))).withColumn("seen_at", parse_compact(F.col("seendate")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = flags(
        ("missing_url", blank("url")), ("invalid_url", F.col("normalized_url").isNull()), ("missing_title", F.col("clean_title") == ""),
        ("missing_timestamp", blank("seendate")), ("invalid_timestamp", F.col("seen_at").isNull()),
    )
    return out.withColumn("quality_flags", found).withColumn("disposition", F.when(F.col("normalized_url").isNull(), "quarantined").otherwise("kept"))


def merge_feed(cleaned: DataFrame, columns: Sequence[str], fields: Sequence[str] = ("domain", "language")) -> DataFrame:
    """One row per normalized_url: observations in the order (time, unknown last; canonical text), each field the first
    that is filled, flags, categories and addresses as sets, and the count of observations. provenance() has them all."""
    kept = cleaned.where("disposition = 'kept'").withColumn("__o", F.struct(F.col("seen_at").isNull().alias("late"), F.col("seen_at").alias("ts"), canonical(cleaned, columns).alias("canon")))
    o = F.col("__o")
    codes = kept.select("normalized_url", F.explode("quality_flags").alias("f")).groupBy("normalized_url").agg(F.array_sort(F.collect_set("f")).alias("quality_flags"))
    merged = kept.groupBy("normalized_url").agg(
        first_filled(F.col("url"), o).alias("original_url"), first_filled(F.col("clean_title"), o).alias("title"), F.min("seen_at").alias("published_at_utc"),
        _union(F.col("query_category")).alias("categories"), _union(F.col("url")).alias("original_urls"), *(first_filled(F.trim(f), o).alias(f) for f in fields), F.count("*").alias("source_record_count"),
    )
    merged = merged.join(codes, "normalized_url", "left").withColumn("quality_flags", F.coalesce("quality_flags", F.array().cast("array<string>")))
    return merged.select(article_id(F.col("normalized_url")).alias("article_id"), *merged.columns)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; Spark cuts groups to one row before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def duplicate_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All members of groups with more than one row: a pre-aggregated count, then a semi-join that can split hot keys."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(many, cond, "left_semi")


def duplicate_count(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, duplicates: rows beyond the first of each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the largest order columns: a partial aggregate, no sort of the group."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
