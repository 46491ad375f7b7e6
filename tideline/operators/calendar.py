"""Forward as-of alignment of timestamped rows to a trading calendar.

Both policies are the same operator: a row is eligible from its local day on, or from the next one if its time of day
has reached the cutoff, and takes effect on the first calendar date from then on. The calendar is spread to one row per
day, so that the as-of join is an equi-join on the day; calendars are small and join by broadcast, if Spark measures
them to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.values import parse_aware, seconds_of


def with_changes(calendar: DataFrame, date_col: str = "date", rate_col: str = "rate") -> DataFrame:
    """The calendar with previous_rate, change and return_pct of each date. One partition: a calendar is one series."""
    w = Window.orderBy(date_col)
    before = F.lag(rate_col).over(w)
    return calendar.select("*", before.alias("previous_rate"), (F.col(rate_col) - before).alias("change"), ((F.col(rate_col) / before - 1) * 100).alias("return_pct"))


def dense_days(calendar: DataFrame, date_col: str = "date", lead_days: int = 0) -> DataFrame:
    """(day, effective) for every day from ``lead_days`` before the first date to the last one: effective is the first
    calendar date from that day on."""
    w = Window.orderBy(date_col)
    days = calendar.select(F.col(date_col).alias("effective")).distinct().withColumnRenamed("effective", date_col)
    start = F.coalesce(F.date_add(F.lag(date_col).over(w), 1), F.date_sub(F.col(date_col), lead_days))
    return days.select(date_col, start.alias("__start")).select(F.explode(F.sequence("__start", date_col)).alias("day"), F.col(date_col).alias("effective"))


def align_forward(rows: DataFrame, calendar: DataFrame, eligible: Column, date_col: str = "date") -> DataFrame:
    """``rows`` with eligible_date and effective_date: the first calendar date not before ``eligible``, null beyond the
    calendar's end. Days before the first date take the first one. Rows keep their number."""
    first = calendar.agg(F.min(date_col)).scalar()  # a subquery of one value, not a join
    days = dense_days(calendar, date_col).select(F.col("day").alias("__day"), F.col("effective").alias("effective_date"))
    staged = rows.withColumn("eligible_date", eligible)
    bounded = staged.withColumn("__key", F.when(F.col("eligible_date").isNotNull(), F.greatest("eligible_date", first)))
    return bounded.join(days, bounded["__key"] == days["__day"], "left").drop("__key", "__day")


def cutoff_seconds(day: Column, default: str, regimes: Sequence[tuple[str, str, str]] = ()) -> Column:
    """The cutoff on a day: that of the regime (first date, last date, HH:MM) that holds it, else the default. Regimes
    that overlap are an error."""
    spans = sorted(regimes)
    for (_, end, _), (start, _, _) in zip(spans, spans[1:], strict=False):
        if start <= end:
            raise ValueError("cutoff regimes overlap")
    picked = F.lit(None).cast("int")
    for start, end, clock in spans:
        picked = F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(seconds_of(clock))).otherwise(picked)
    return F.coalesce(picked, F.lit(seconds_of(default)))


def local_parts(ts: Column) -> tuple[Column, Column]:
    """Local day and second of the day of a local wall time."""
    return F.to_date(ts), F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def align_strict(rows: DataFrame, calendar: DataFrame, local: Column, cutoff: str = "15:00", regimes: Sequence[tuple[str, str, str]] = (), date_col: str = "date") -> DataFrame:
    """Alignment by exact local wall times (null: not known): adds effective_date and alignment_reason, one of
    same_day_before_cutoff, after_cutoff_next_trade_day, weekend_next_trade_day, non_trading_day_next_trade_day,
    missing_exact_timestamp_unaligned, beyond_calendar_unaligned. A time at the cutoff is after it."""
    day, second = local_parts(F.col("__local"))
    staged = rows.withColumn("__local", local).withColumn("__on", day)
    after = second >= cutoff_seconds(F.col("__on"), cutoff, regimes)
    found = align_forward(staged.withColumn("__after", after), calendar, F.date_add(F.col("__on"), F.col("__after").cast("int")), date_col)
    trading = calendar.select(F.col(date_col).alias("__open")).distinct()
    found = found.join(trading, found["__on"] == trading["__open"], "left")
    reason = (
        F.when(F.col("__local").isNull(), "missing_exact_timestamp_unaligned")
        .when(F.col("effective_date").isNull(), "beyond_calendar_unaligned")
        .when(F.col("__open").isNotNull(), F.when(F.col("__after"), "after_cutoff_next_trade_day").otherwise("same_day_before_cutoff"))
        .when(F.weekday("__on") >= 5, "weekend_next_trade_day")
        .otherwise("non_trading_day_next_trade_day")
    )
    # a non-trading day is no date of the calendar: from the day itself and from the next the first date is the same
    return found.withColumn("alignment_reason", reason).drop("__local", "__on", "__after", "__open", "eligible_date")


def align_lenient(rows: DataFrame, calendar: DataFrame, local: Column, day_only: Column, cutoff: str = "16:00", date_col: str = "date") -> DataFrame:
    """Alignment by local wall time or, without one, by the date alone: adds event_date, alignment_basis, eligible_date,
    effective_date, lag_days (calendar days from event to effect) and alignment_reason."""
    day, second = local_parts(F.col("__local"))
    staged = rows.withColumn("__local", local).withColumn("__date", day_only)
    staged = staged.withColumn("event_date", F.coalesce(day, F.col("__date"))).withColumn("__after", F.coalesce(second >= seconds_of(cutoff), F.lit(False)))
    staged = staged.withColumn("alignment_basis", F.when(F.col("__local").isNotNull(), "timestamp").when(F.col("__date").isNotNull(), "publication_date_only").otherwise(""))
    found = align_forward(staged, calendar, F.date_add("event_date", F.col("__after").cast("int")), date_col)
    same = F.col("effective_date") == F.col("eligible_date")
    reason = (
        F.when(F.col("event_date").isNull(), "invalid_or_missing_publication_time")
        .when(F.col("effective_date").isNull(), "beyond_calendar_range")
        .when(F.col("alignment_basis") == "publication_date_only", F.when(same, "date_only_same_trading_day").otherwise("date_only_next_trading_day"))
        .when(F.col("__after"), F.when(same, "after_market_close").otherwise("after_market_close_next_trading_day"))
        .otherwise(F.when(same, "same_trading_day").otherwise("next_trading_day"))
    )
    return found.withColumn("lag_days", F.datediff("effective_date", "event_date")).withColumn("alignment_reason", reason).drop("__local", "__date", "__after")


def local_time(text: Column, zone: str) -> Column:
    """The wall time in ``zone`` of a text that names its offset; null otherwise."""
    return F.from_utc_timestamp(parse_aware(text), zone)


def validate_calendar(calendar: DataFrame, date_col: str = "date", rate_col: str = "rate") -> DataFrame:
    """The calendar, if its dates are unique and present and its rates finite and positive; else ValueError."""
    bad = calendar.agg(
        F.count_if(F.col(date_col).isNull()).alias("dates"), (F.count(date_col) - F.count_distinct(date_col)).alias("repeated"),
        F.count_if(F.col(rate_col).isNull() | F.isnan(rate_col) | ~((F.col(rate_col) > 0) & (F.col(rate_col) < float("inf")))).alias("rates"), F.count("*").alias("rows"),
    ).head()
    if not bad["rows"] or bad["dates"] or bad["repeated"] or bad["rates"]:
        raise ValueError(f"not a calendar: {bad.asDict()}")
    return calendar
