"""Alignment of events to a weekday calendar, daily aggregates, collector windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.values import window_leaves
from tideline.operators import calendar as cal
from tideline.operators import envelopes, features, models

from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

CALENDAR = "cal AS (SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS rate FROM events WHERE isodow(ts) < 6 AND day(ts) NOT IN (1, 15) GROUP BY 1)"
LOCAL = "loc AS (SELECT event_id, event_type, value, ts + INTERVAL 7 HOUR AS local FROM events)"
STRICT = f"""{CALENDAR}, {LOCAL}, el AS (SELECT *, CAST(local AS DATE) AS d, CAST(local AS TIME) >= TIME '15:00:00' AS late FROM loc),
al AS (SELECT event_id, event_type, value, d, late, c.date AS effective_date, d IN (SELECT date FROM cal) AS open FROM (SELECT *, d + CAST(late AS INT) AS e FROM el) x ASOF LEFT JOIN cal c ON x.e <= c.date),
st AS (SELECT event_id, event_type, value, effective_date, CASE WHEN effective_date IS NULL THEN 'beyond_calendar_unaligned' WHEN open THEN CASE WHEN late THEN 'after_cutoff_next_trade_day' ELSE 'same_day_before_cutoff' END
  WHEN isodow(d) > 5 THEN 'weekend_next_trade_day' ELSE 'non_trading_day_next_trade_day' END AS alignment_reason FROM al)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of the events but the 1st and the 15th, with the mean value as the rate."""
    rows = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return rows.where((F.weekday("date") < 5) & ~F.dayofmonth("date").isin(1, 15)).groupBy("date").agg(F.round(F.avg("value"), 6).alias("rate"))


def local():
    """Wall time seven hours ahead."""
    return F.col("ts") + F.expr("INTERVAL 7 HOURS")


def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events aligned by the strict policy."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    return cal.align_strict(rows, calendar(spark, sf_dir), local(), "15:00").select("event_id", "event_type", "value", "effective_date", "alignment_reason")


@R.query(f"WITH {STRICT} SELECT event_id, effective_date, alignment_reason FROM st")
def alignment_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's effective date and reason."""
    return strict(spark, sf_dir).select("event_id", "effective_date", "alignment_reason")


@R.query(f"WITH {STRICT} SELECT alignment_reason, count(*) AS n FROM st GROUP BY 1")
def alignment_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per reason."""
    return strict(spark, sf_dir).groupBy("alignment_reason").agg(F.count("*").alias("n"))


@R.query(f"""WITH {STRICT}, ch AS (SELECT date, lag(rate) OVER (ORDER BY date) AS previous_rate, rate FROM cal)
SELECT event_id, effective_date, previous_rate, rate, round(rate - previous_rate, 6) AS change FROM st LEFT JOIN ch ON ch.date = st.effective_date""")
def alignment_with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned events with the rate's move on their date; all events stay."""
    moves = cal.with_changes(calendar(spark, sf_dir)).select("date", "previous_rate", "rate", "change")
    found = strict(spark, sf_dir)
    return rounded(found.join(moves, found["effective_date"] == moves["date"], "left").select("event_id", "effective_date", "previous_rate", "rate", "change"))


@R.query(f"""WITH {CALENDAR}, {LOCAL}, x AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN local END AS local, CASE WHEN event_id % 3 = 1 OR event_id % 6 = 0 THEN CAST(local AS DATE) END AS pub FROM loc),
y AS (SELECT *, coalesce(CAST(local AS DATE), pub) AS event_date, coalesce(CAST(local AS TIME) >= TIME '16:00:00', false) AS late, CASE WHEN local IS NOT NULL THEN 'timestamp' WHEN pub IS NOT NULL THEN 'publication_date_only' ELSE '' END AS alignment_basis FROM x),
z AS (SELECT *, event_date + CAST(late AS INT) AS eligible_date FROM y), w AS (SELECT z.*, c.date AS effective_date FROM z ASOF LEFT JOIN cal c ON z.eligible_date <= c.date)
SELECT event_id, event_date, alignment_basis, eligible_date, effective_date, CAST(effective_date - event_date AS INT) AS lag_days,
CASE WHEN event_date IS NULL THEN 'invalid_or_missing_publication_time' WHEN effective_date IS NULL THEN 'beyond_calendar_range'
 WHEN alignment_basis = 'publication_date_only' THEN CASE WHEN effective_date = eligible_date THEN 'date_only_same_trading_day' ELSE 'date_only_next_trading_day' END
 WHEN late THEN CASE WHEN effective_date = eligible_date THEN 'after_market_close' ELSE 'after_market_close_next_trading_day' END
 ELSE CASE WHEN effective_date = eligible_date THEN 'same_trading_day' ELSE 'next_trading_day' END END AS alignment_reason FROM w""")
def alignment_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lenient policy: a third of the events lack a time, half of those a date, too."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    i = F.col("event_id")
    when = F.when(i % 3 != 0, local())
    pub = F.when((i % 3 == 1) | (i % 6 == 0), F.to_date(local()))
    return cal.align_lenient(rows, calendar(spark, sf_dir), when, pub, "16:00").drop("ts")


@R.query(f"""WITH {LOCAL} SELECT event_id, CAST(CASE WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' THEN 50400 WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' THEN 59400 ELSE 54000 END AS INT) AS cutoff FROM loc""")
def cutoff_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff that holds on each event's day."""
    spans = [("2024-01-05", "2024-01-12", "14:00"), ("2024-01-20", "2024-01-22", "16:30")]
    return table(spark, sf_dir, "events").select("event_id", cal.cutoff_seconds(F.to_date(local()), "15:00", spans).alias("cutoff"))


#: All types that events have.
TYPES = ("click", "view", "purchase", "signup", "error")
_SQL_TYPES = ", ".join(f"count(*) FILTER (event_type = '{t}') AS count_{t}, avg(value) FILTER (event_type = '{t}') AS mean_value_{t}" for t in TYPES)


@R.query(f"""WITH {STRICT}, g AS (SELECT effective_date, count(event_id) AS news_count, avg(value) AS mean_value, {_SQL_TYPES} FROM st WHERE effective_date IS NOT NULL GROUP BY 1)
SELECT date, coalesce(news_count, 0) AS news_count, round(round(coalesce(mean_value, 0), 9), 6) AS mean_value, {", ".join(f"coalesce(count_{t}, 0) AS count_{t}, round(round(coalesce(mean_value_{t}, 0), 9), 6) AS mean_value_{t}" for t in TYPES)} FROM cal LEFT JOIN g ON g.effective_date = cal.date""")
def alignment_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per calendar date the count and mean value, in all and per event type; 0 without events."""
    rows = strict(spark, sf_dir).withColumn("kinds", F.array("event_type"))
    found = features.daily(rows, calendar(spark, sf_dir), "event_id", "effective_date", TYPES, ["value"], "kinds").drop("rate")
    # sums of doubles depend on the order of rows; without their noise, means of 64 rows that lie between two sixth digits tie
    return rounded(found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("mean_")}))


@R.query(f"""WITH {STRICT}, a AS (SELECT effective_date AS d, count(*) AS n FROM st WHERE effective_date IS NOT NULL GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)
SELECT count(*) FILTER (a.d IS NOT NULL AND b.d IS NOT NULL) AS matched, count(*) FILTER (b.d IS NULL) AS left_only, count(*) FILTER (a.d IS NULL) AS right_only, count(*) FILTER (a.d IS NOT NULL AND b.d IS NOT NULL AND a.n <> b.n) AS differ_n FROM a FULL JOIN b ON a.d = b.d""")
def reconcile_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned counts against raw counts by day."""
    a = strict(spark, sf_dir).where("effective_date is not null").groupBy(F.col("effective_date").alias("d")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return features.reconcile(a, b, "d", ["n"])


@R.query("""WITH w AS (SELECT CAST(ts AS DATE) AS d, min(date_trunc('minute', ts)) AS s, max(date_trunc('minute', ts)) AS e FROM events GROUP BY 1 HAVING max(date_trunc('minute', ts)) > min(date_trunc('minute', ts))),
u AS (SELECT d, s, e, greatest(CAST(floor((epoch(e) - epoch(s)) / 900) AS BIGINT), 1) AS n FROM w) SELECT d, count(*) AS leaves, CAST(max(CASE WHEN i = n - 1 THEN epoch(e) - epoch(s) - 900 * i ELSE 900 END) AS BIGINT) AS longest FROM (SELECT *, unnest(range(0, n)) AS i FROM u) GROUP BY d""")
def window_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of bisecting each day's span of events, and the longest, in seconds."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.min(minute).alias("s"), F.max(minute).alias("e")).where("e > s")
    leaves = spans.select("d", F.explode(window_leaves(F.col("s"), F.col("e"))).alias("l"))
    return leaves.groupBy("d").agg(F.count("*").alias("leaves"), F.max(F.unix_timestamp("l.end") - F.unix_timestamp("l.start")).alias("longest"))


_WINDOWS = "w AS (SELECT event_type AS ctx, event_id, user_id % 20 AS s, user_id % 20 + 1 + event_id % 7 AS e, CASE WHEN event_id % 4 = 0 THEN 'split' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS status FROM events)"


@R.query(f"WITH {_WINDOWS}, h AS (SELECT DISTINCT ctx, s, e, status FROM w) SELECT a.event_id FROM w a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.ctx = a.ctx AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e) AND b.status <> 'split')")
def ancestor_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that no holding window blocks; each event stands for one."""
    i, u = F.col("event_id"), F.col("user_id")
    status = F.when(i % 4 == 0, "split").when(i % 4 == 1, "failed").otherwise("completed")
    windows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ctx"), "event_id", (u % 20).alias("start"), (u % 20 + 1 + i % 7).alias("end"), status.alias("status"))
    return envelopes.unblocked(windows, ["ctx"]).select("event_id")


@R.query("""WITH f AS (SELECT event_id, event_type, CAST(value < 20 AS INT) AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM f),
r AS (SELECT *, sum(f) OVER (PARTITION BY event_type, g ORDER BY event_id) AS n FROM g) SELECT event_id, event_type, CAST(n AS BIGINT) AS failures_in_a_row FROM r WHERE f = 1 AND n = 3""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which three low values in a row are reached, per type."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return envelopes.circuit_breaks(rows, "event_id", F.col("value") < 20, 3, ["event_type"]).select("event_id", "event_type", "failures_in_a_row")


@R.query("SELECT event_type, user_id % 10 AS bucket, bool_and(ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-29') AS wrong_window FROM events GROUP BY 1, 2")
def wrong_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose events all lie outside the requested span."""
    rows = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return envelopes.entirely_outside(rows, ["event_type", "bucket"], F.col("ts"), at("2024-01-03"), at("2024-01-29"))


@R.query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def scope_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the half-open study span, per type."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return envelopes.in_scope(table(spark, sf_dir, "events"), F.col("ts"), at("2024-01-05"), at("2024-01-20")).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("""WITH e AS (SELECT user_id, event_id AS attempt, CASE WHEN value < 50 THEN 'failed' ELSE 'completed' END AS status FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempt DESC) AS k FROM e) SELECT user_id, attempt, status FROM r WHERE k = 1""")
def newest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest attempt of each user's events, failed or not."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("attempt"), F.when(F.col("value") < 50, "failed").otherwise("completed").alias("status"), F.lit("").alias("path"))
    return envelopes.newest_attempts(rows, ["user_id"]).drop("path")


@R.query("""WITH j AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 50) SELECT user_id, event_type FROM j WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = j.user_id AND d.event_type = j.event_type)""")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (user, type) without a completed run."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") < 50, "failed").otherwise("completed").alias("status"))
    return envelopes.pending(rows.select("user_id", "event_type").distinct(), rows, ["user_id", "event_type"])


@R.query("WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT DISTINCT event_type AS topic FROM events), r AS (SELECT r_name AS domain FROM region) SELECT day, topic, domain FROM d, t, r")
def collection_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by topics by domains."""
    events = table(spark, sf_dir, "events")
    return envelopes.job_list(events.select(F.to_date("ts").alias("day")).distinct(), events.select(F.col("event_type").alias("topic")).distinct(), table(spark, sf_dir, "region").select(F.col("r_name").alias("domain")))


@R.query(f"""WITH {STRICT}, g AS (SELECT effective_date, avg(value) AS a, avg(event_id % 7) AS b FROM st WHERE effective_date IS NOT NULL GROUP BY 1)
SELECT date, round(round(coalesce(a, 0), 9), 6) AS svd_0, round(round(coalesce(b, 0), 9), 6) AS svd_1 FROM cal LEFT JOIN g ON g.effective_date = cal.date""")
def calendar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the aligned events on each calendar date, 0 without any."""
    rows = strict(spark, sf_dir).select("effective_date", F.array(F.col("value"), (F.col("event_id") % 7).cast("double")).alias("svd"))
    found = models.daily_vectors(rows, "effective_date", 2, calendar(spark, sf_dir))
    return rounded(found.withColumns({c: F.round(c, 9) for c in ("svd_0", "svd_1")}))


@R.query("""SELECT user_id, event_type, count(*) AS n, (user_id % 3 <> 0) AND (count(DISTINCT event_id % 50) = count(*) OR user_id % 2 = 0) AS intact FROM events GROUP BY user_id, event_type""")
def envelope_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of each user's events by type: whether they hold what they report, without repeats over pages."""
    u = F.col("user_id")
    records = F.collect_list(F.struct((F.col("event_id") % 50).cast("string").alias("url"))).alias("records")
    found = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(records)
    found = found.withColumns({"reported_total_count": F.size("records") + (u % 3 == 0).cast("int"), "pages": u % 2 + 1})
    return envelopes.integrity(found).select("user_id", "event_type", F.size("records").cast("long").alias("n"), "intact")
