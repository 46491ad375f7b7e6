"""Collector envelopes: newest attempts, ancestor windows, gaps, scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import latest_per_key


def newest_attempts(envelopes: DataFrame, keys: Sequence[str], attempt: str = "attempt", tie: str = "path") -> DataFrame:
    """The newest attempt of each identity, whatever its status: an older success never returns."""
    return latest_per_key(envelopes, keys, [attempt, tie])


def completed_records(envelopes: DataFrame, keys: Sequence[str], start: str | None = None, end: str | None = None, day: str = "archive_date") -> DataFrame:
    """The records of the newest attempts that completed, one row each, days in [start, end]."""
    rows = envelopes if start is None else envelopes.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rest = [c for c in rows.columns if c not in ("records",)]
    return newest_attempts(rows, keys).where("status = 'completed'").select(*rest, F.explode("records").alias("record"))


def integrity(envelopes: DataFrame) -> DataFrame:
    """Adds intact: as many records as reported and, over several pages, no address twice."""
    urls = F.transform("records", lambda r: r["url"])
    unique = F.size(F.array_distinct(urls)) == F.size("records")
    return envelopes.withColumn("intact", (F.size("records") == F.col("reported_total_count")) & (unique | (F.col("pages") <= 1)))


def unblocked(windows: DataFrame, context: Sequence[str]) -> DataFrame:
    """Windows (start, end, status) that no other window of the context that holds them, other than a split one, blocks.
    Windows of the same bounds don't block each other. Whether a window is blocked depends on its bounds alone, so that
    only distinct bounds meet in the theta join inside each context."""
    bounds = windows.select(*context, "start", "end").distinct().alias("a")
    holders = windows.where("status <> 'split'").select(*context, "start", "end").distinct().alias("b")
    cond = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")) & ((F.col("b.start") < F.col("a.start")) | (F.col("a.end") < F.col("b.end")))
    for c in context:
        cond = (F.col(f"a.{c}") == F.col(f"b.{c}")) & cond
    free = bounds.join(holders, cond, "left_anti")
    return windows.join(free, [*context, "start", "end"], "left_semi")


def entirely_outside(rows: DataFrame, keys: Sequence[str], ts: Column, start: Column, end: Column) -> DataFrame:
    """(keys, wrong_window): true if there are records and each has a valid time outside [start, end)."""
    outside = ts.isNotNull() & ~((ts >= start) & (ts < end))
    return rows.groupBy(*keys).agg((F.bool_and(outside) & (F.count("*") > 0)).alias("wrong_window"))


def in_scope(rows: DataFrame, ts: Column, start: Column, end: Column) -> DataFrame:
    """Rows inside [start, end); rows without a time stay."""
    return rows.where(ts.isNull() | ((ts >= start) & (ts < end)))


def circuit_breaks(jobs: DataFrame, order: str, failed: Column, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The jobs at which ``n`` failures in a row are reached (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    staged = jobs.withColumn("__f", failed.cast("int")).withColumn("__g", F.sum(1 - F.col("__f")).over(w))
    run = Window.partitionBy(*by, "__g").orderBy(order)
    return staged.withColumn("failures_in_a_row", F.sum("__f").over(run)).where((F.col("__f") == 1) & (F.col("failures_in_a_row") == n)).drop("__f", "__g")


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a completed run of the same keys (identity and configuration hash)."""
    return jobs.join(done.where("status = 'completed'").select(*keys).distinct(), list(keys), "left_anti")


def cached(queue: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The queue with hit: whether the cache has a completed entry of the same keys (id, address, parser version)."""
    known = cache.where("status = 'completed'").select(*keys).distinct().withColumn("__hit", F.lit(True))
    return queue.join(known, list(keys), "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def job_list(days: DataFrame, topics: DataFrame, domains: DataFrame) -> DataFrame:
    """Every day with every topic and domain; three small dimension tables."""
    return days.join(topics).join(domains)
