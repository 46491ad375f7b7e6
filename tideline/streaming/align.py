"""Alignment of a stream to the calendar: stateless, hence with the batch operator's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.values import seconds_of
from tideline.operators.calendar import dense_days, local_parts


def align_stream(stream: DataFrame, calendar: DataFrame, local: Column, cutoff: str = "15:00") -> DataFrame:
    """The stream with effective_date; a stream-static equi-join on the eligible day. Days before the calendar's first
    date have none here, as an unbounded past can't be spread out."""
    day, second = local_parts(local)
    days = dense_days(calendar).select(F.col("day").alias("__day"), F.col("effective").alias("effective_date"))
    keyed = stream.withColumn("__key", F.date_add(day, (second >= seconds_of(cutoff)).cast("int")))
    return keyed.join(days, keyed["__key"] == days["__day"], "left").drop("__key", "__day")


def daily_stream(stream: DataFrame, ts: str, key: str, watermark: str = "2 days") -> DataFrame:
    """(window, key, n) per day; events later than the watermark don't count."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("n"))
