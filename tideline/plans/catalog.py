"""All queries of the library outside its text-corpus subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exploration, news, prices, text_features

_PARTS = (prices, alignment, news, text_features, exploration)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
