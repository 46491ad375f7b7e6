"""What the query modules share: tables, registration, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers the function under its name."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6, *skip: str) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


def day(column: str) -> Column:
    """The date of a timestamp column."""
    return F.to_date(F.col(column))
