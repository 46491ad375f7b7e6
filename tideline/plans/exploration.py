"""Descriptive statistics, label metrics, value parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import values
from tideline.operators import features, stats

from .base import Registry, rounded, table
from .prices import METRICS

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders")
def describe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of order values."""
    return rounded(stats.describe(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@R.query("SELECT CAST(least(floor((l_quantity - 0) / (50.0 / 10)) + 1, 10) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins of quantities."""
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10)


TYPES = ("click", "view", "purchase", "signup", "error")


@R.query("SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by day, one column per event type."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(rows.groupBy("day").pivot("event_type", list(TYPES)).agg(F.avg("value")))


@R.query("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / sum(1), 6) AS share_f, round(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) / sum(1), 6) AS share_o FROM orders GROUP BY 1")
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of order states per priority."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("f"), (F.col("o_orderstatus") == "O").cast("int").alias("o"), F.lit(1).alias("one"))
    return rounded(stats.shares(rows, ["o_orderpriority"], ["f", "o"], "one"))


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per combination, most frequent first."""
    return stats.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@R.query("SELECT event_type, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(DISTINCT user_id) AS users, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, distinct users and a conjunction per type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), F.count_distinct("user_id").alias("users"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@R.query(f"WITH k AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels) SELECT {METRICS} FROM k")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label judged as a prediction of the other."""
    return rounded(stats.metrics(stats.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))


@R.query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1")
def monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and count per month."""
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM"))
    return rounded(rows.groupBy("month").agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"), F.count("*").alias("n")), 4)


@R.query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, o_totalprice AS rate, CAST(NULL AS DATE) AS serial FROM orders")
def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and rates read back from the texts that a sheet would hold; serial numbers aren't dates."""
    o = table(spark, sf_dir, "orders")
    us = F.date_format("o_orderdate", "M/d/yyyy")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    text = F.concat(F.lit("Rp "), F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", values.parse_date(F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(iso)).alias("parsed"), values.parse_rate(text).alias("rate"), values.parse_date(F.col("o_orderkey").cast("string")).alias("serial"))


@R.query("SELECT event_id, CAST(date_trunc('second', ts) AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 'exact' ELSE 'different' END END AS agreement FROM events")
def aware_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact and zoned timestamps parsed back; agreement of dates."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    compact = F.concat(F.date_format("t", "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    zoned = F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    parsed = values.parse_compact(F.when(F.col("event_id") % 3 == 0, zoned).otherwise(compact))
    other = F.when(F.col("event_id") % 2 == 0, F.to_date("t")).otherwise(F.lit("2024-01-10").cast("date"))
    return rows.select("event_id", F.to_date(parsed).alias("day"), values.date_agreement(zoned, other).alias("agreement"))


@R.query("WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) SELECT date, round(ln(1 + n), 6) AS n, round(CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w END, 6) AS mean_7 FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day mean of event counts, and their log."""
    from pyspark.sql import Window

    w = Window.orderBy("date").rowsBetween(-6, 0)
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    days = days.withColumn("mean_7", F.when(F.count("*").over(w) == 7, F.avg("n").over(w)))
    return rounded(features.log_volumes(days, ["n"]))
