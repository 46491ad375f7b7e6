"""JSON envelopes of collectors, one file per attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.envelopes import completed_records, newest_attempts, unblocked

#: Archive envelopes: one per day and attempt.
ARCHIVE = "archive_date date, status string, attempt int, reported_total_count int, pages int, config_hash string, records array<struct<__typename:string,title:string,url:string,discovered_for_date:string,archive_url:string,retrieved_at_utc:string>>"
#: Feed envelopes: one per window and attempt.
FEED = (
    "identity struct<query:string,topic:string,domain:string,logical_start:timestamp,logical_end:timestamp,api_config:string>, status string, attempt int, "
    "records array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string,query_category:string,query_string:string,retrieved_at_utc:string>>"
)
IDENTITY = ("query", "topic", "domain", "logical_start", "logical_end", "api_config")


def read_envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files below ``path`` with a declared schema, and the file's path."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))


def archive_records(envelopes: DataFrame, start: str, end: str) -> DataFrame:
    """The records of the newest completed attempt of each day in the range. Days are pruned before records explode."""
    return completed_records(envelopes, ["archive_date"], start, end).select("archive_date", "attempt", "record.*")


def feed_records(envelopes: DataFrame) -> DataFrame:
    """The records of the newest attempts that completed, of windows that no ancestor which wasn't split blocks."""
    flat = envelopes.select(*(F.col(f"identity.{c}").alias(c) for c in IDENTITY), "status", "attempt", "path", "records")
    newest = newest_attempts(flat, list(IDENTITY)).withColumnsRenamed({"logical_start": "start", "logical_end": "end"})
    free = unblocked(newest, ["query", "topic", "domain", "api_config"])
    return free.where("status = 'completed'").withColumn("record", F.explode("records")).select("query", "topic", "start", "end", "attempt", "record.*")


def saturated(envelopes: DataFrame, most: int) -> DataFrame:
    """Adds saturated: the response reached the cap, so that its window has to be split."""
    return envelopes.withColumn("saturated", F.size("records") >= most)
