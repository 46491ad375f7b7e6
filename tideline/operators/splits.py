"""Temporal splits, baselines and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_rows(rows: DataFrame, train: float = 0.70, validation: float = 0.15, purge: int = 1, date_col: str = "date") -> DataFrame:
    """Adds idx and split (train, validation, test, purged) by date: the shares are cut down to whole rows, and the last
    ``purge`` rows of train and validation are purged. The size comes from a window, not from an action."""
    w = Window.orderBy(date_col)
    n = F.count("*").over(Window.partitionBy())
    out = rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("__n", n)
    a = F.floor(F.col("__n") * train + 1e-9)
    b = a + F.floor(F.col("__n") * validation + 1e-9)
    i = F.col("idx")
    split = F.when(i < a - purge, "train").when(i < a, "purged").when(i < b - purge, "validation").when(i < b, "purged").otherwise("test")
    return out.withColumn("split", split).drop("__n")


def split_summary(rows: DataFrame, date_col: str = "date", target: str = "y") -> DataFrame:
    """Per split: n, first and last date, share of positives."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"), F.avg(target).alias("up_share"))


def purged_rows(rows: DataFrame, *splits: DataFrame, on: str = "date") -> DataFrame:
    """The rows that are in none of the splits."""
    for s in splits:
        rows = rows.join(s.select(on), on, "left_anti")
    return rows


def baselines(rows: DataFrame, fit: str = "train", target: str = "y") -> DataFrame:
    """Adds b0_pred (majority of the fit split, ties up) and b1_pred (sign of the last return)."""
    share = rows.where(F.col("split") == fit).agg(F.avg(target)).scalar()  # a subquery of one value, not a join
    return rows.withColumn("b0_pred", (share >= 0.5).cast("int")).withColumn("b1_pred", (F.col("ret_lag_0") > 0).cast("int"))


def leakage_checks(rows: DataFrame, date_col: str = "date") -> DataFrame:
    """One row of booleans: splits in order of time, no shared dates, no null features or targets."""
    last = lambda s: F.max(F.when(F.col("split") == s, F.col(date_col)))
    first = lambda s: F.min(F.when(F.col("split") == s, F.col(date_col)))
    features = [c for c in rows.columns if c not in (date_col, "split", "idx")]
    no_null = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in features), F.lit(0)) > 0) == 0
    return rows.agg((last("train") < first("validation")).alias("train_before_validation"), (last("validation") < first("test")).alias("validation_before_test"),
                    (F.count(date_col) == F.count_distinct(date_col)).alias("dates_unique"), no_null.alias("no_nulls"))


def month_folds(rows: DataFrame, least: int = 30, date_col: str = "date") -> list[str]:
    """The months (first days) that have ``least`` rows or more before them; a list as long as the calendar has months."""
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy(F.trunc(date_col, "MM").alias("month")).count()
    seen = months.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    return [r[0].isoformat() for r in seen.where(F.col("before") >= least).orderBy("month").select("month").collect()]
