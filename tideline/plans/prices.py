"""Price features, targets, splits, baselines and models on the daily order value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import features, models, splits, stats

from .base import Registry, day, rounded, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

SERIES = "s AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS rate FROM orders GROUP BY 1)"
FEATURES = f"""{SERIES}, r AS (SELECT date, rate, (rate / lag(rate) OVER (ORDER BY date) - 1) * 100 AS ret, row_number() OVER (ORDER BY date) - 1 AS row FROM s),
f AS (SELECT date, rate, row, ret,
  lag(ret, 1) OVER w AS ret_lag_1, lag(ret, 2) OVER w AS ret_lag_2, lag(ret, 3) OVER w AS ret_lag_3, lag(ret, 4) OVER w AS ret_lag_4,
  CASE WHEN count(ret) OVER w5 = 5 THEN avg(ret) OVER w5 END AS momentum_5, CASE WHEN count(ret) OVER w20 = 20 THEN avg(ret) OVER w20 END AS momentum_20,
  CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS volatility_20, CASE WHEN count(rate) OVER w20 = 20 THEN rate / avg(rate) OVER w20 - 1 END AS ma_dist_20,
  lead(ret) OVER w AS ret_next
  FROM r WINDOW w AS (ORDER BY date), w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN ret_next IS NOT NULL THEN CAST(ret_next > 0 AS INT) END AS y FROM f)"""
MODEL = f"""{FEATURES}, t AS (SELECT * FROM m WHERE row >= 20 AND y IS NOT NULL),
i AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM t),
b AS (SELECT *, floor(n * 0.7 + 1e-9) AS a1, floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) AS a2 FROM i),
p AS (SELECT *, CASE WHEN idx < a1 - 1 THEN 'train' WHEN idx < a1 THEN 'purged' WHEN idx < a2 - 1 THEN 'validation' WHEN idx < a2 THEN 'purged' ELSE 'test' END AS split FROM b)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mean order value as a price series."""
    return table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("rate"))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split modeling rows of the series."""
    return splits.split_rows(features.modeling_rows(features.price_features(series(spark, sf_dir))))


@R.query(f"""WITH {FEATURES} SELECT date, rate, round(ret, 6) AS ret, round(ret_lag_1, 6) AS ret_lag_1, round(ret_lag_2, 6) AS ret_lag_2, round(ret_lag_3, 6) AS ret_lag_3, round(ret_lag_4, 6) AS ret_lag_4,
round(momentum_5, 6) AS momentum_5, round(momentum_20, 6) AS momentum_20, round(volatility_20, 6) AS volatility_20, round(ma_dist_20, 6) AS ma_dist_20, round(ret_next, 6) AS ret_next, y,
CAST(isodow(date) = 2 AS INT) AS dow_1, CAST(isodow(date) = 3 AS INT) AS dow_2, CAST(isodow(date) = 4 AS INT) AS dow_3, CAST(isodow(date) = 5 AS INT) AS dow_4 FROM m""")
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, lags, momentum, volatility, distance to the average, weekday dummies, next-day target."""
    return rounded(features.price_features(series(spark, sf_dir)).drop("row", "ret_lag_0"))


@R.query(f"WITH {SERIES} SELECT date, rate, lag(rate) OVER w AS previous_rate, round(rate - lag(rate) OVER w, 6) AS change, round((rate / lag(rate) OVER w - 1) * 100, 6) AS return_pct FROM s WINDOW w AS (ORDER BY date)")
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous rate, change and return of each date."""
    from tideline.operators.calendar import with_changes

    return rounded(with_changes(series(spark, sf_dir)))


@R.query(f"WITH {MODEL} SELECT date, CAST(idx AS INT) AS idx, split, y FROM p")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split labels with purge rows."""
    return model_rows(spark, sf_dir).select("date", F.col("idx").cast("int").alias("idx"), "split", "y")


@R.query(f"WITH {MODEL} SELECT split, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(avg(y), 6) AS up_share FROM p GROUP BY split")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bounds and share of positives per split."""
    return rounded(splits.split_summary(model_rows(spark, sf_dir)))


@R.query(f"WITH {MODEL} SELECT date, idx::INT AS idx FROM p WHERE split = 'purged'")
def purge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are in no split."""
    rows = model_rows(spark, sf_dir).select("date", F.col("idx").cast("int").alias("idx"), "split")
    return splits.purged_rows(rows.select("date", "idx"), *(rows.where(F.col("split") == s) for s in ("train", "validation", "test")))


@R.query(f"WITH {MODEL}, g AS (SELECT avg(y) AS s FROM p WHERE split = 'train') SELECT date, y, CAST((SELECT s FROM g) >= 0.5 AS INT) AS b0_pred, CAST(ret > 0 AS INT) AS b1_pred FROM p WHERE split = 'test'")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority and persistence on the test split."""
    return splits.baselines(model_rows(spark, sf_dir)).where("split = 'test'").select("date", "y", "b0_pred", "b1_pred")


_CONFUSION = "SELECT count(*) AS n, count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 0) AS tn, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn FROM c"
METRICS = """n, tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy,
round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 6) AS macro_f1,
round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy,
round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0 END, 6) AS mcc"""


@R.query(f"WITH {MODEL}, c AS (SELECT y, CAST(ret > 0 AS INT) AS q FROM p WHERE split = 'test'), k AS ({_CONFUSION}) SELECT {METRICS} FROM k")
def persistence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and MCC of persistence."""
    rows = splits.baselines(model_rows(spark, sf_dir)).where("split = 'test'")
    return rounded(stats.metrics(stats.confusion(rows, "y", "b1_pred")))


@R.query(f"WITH {MODEL}, g AS (SELECT avg(y) AS s FROM p WHERE split = 'train'), c AS (SELECT y, CAST((SELECT s FROM g) >= 0.5 AS INT) AS p0, CAST(ret > 0 AS INT) AS p1 FROM p WHERE split = 'test') SELECT count(*) FILTER (p0 = y AND p1 <> y) AS b, count(*) FILTER (p0 <> y AND p1 = y) AS c FROM c")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of the two baselines."""
    return stats.discordant(splits.baselines(model_rows(spark, sf_dir)).where("split = 'test'"), "y", "b0_pred", "b1_pred")


@R.query(f"""WITH {MODEL}, v AS (SELECT idx - min(idx) OVER () AS i, CAST(CAST(ret > 0 AS INT) = y AS INT) AS hit, count(*) OVER () AS n FROM p WHERE split = 'test'),
st AS (SELECT r, k, (r * 7919 + k * 104729) % ((SELECT max(n) FROM v) - 9) AS start FROM range(0, 50) a(r), range(0, (SELECT CAST(ceil(max(n) / 10.0) AS BIGINT) FROM v)) b(k)),
e AS (SELECT r, k * 10 + o AS at, start + o AS i FROM st, range(0, 10) c(o)), q AS (SELECT r, avg(hit) AS m FROM e JOIN v ON v.i = e.i WHERE e.at < v.n GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS mean FROM q""")
def block_bootstrap_fixed_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving-block bootstrap of the accuracy of persistence, with given starts."""
    rows = splits.baselines(model_rows(spark, sf_dir)).where("split = 'test'")
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = rows.count()
    starts = spark.range(50).select(F.col("id").cast("int").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // 10) - 1))).alias("block"))
    starts = starts.select("resample", "block", ((F.col("resample") * 7919 + F.col("block") * 104729) % (n - 9)).cast("int").alias("start"))
    return rounded(stats.block_bootstrap(rows, starts, 10, n, (F.col("b1_pred") == F.col("y")).cast("double"), idx="i"))


@R.query(f"""WITH {MODEL} SELECT max(date) FILTER (split = 'train') < min(date) FILTER (split = 'validation') AS train_before_validation, max(date) FILTER (split = 'validation') < min(date) FILTER (split = 'test') AS validation_before_test,
count(date) = count(DISTINCT date) AS dates_unique, count(*) FILTER (ret IS NULL OR momentum_20 IS NULL OR y IS NULL) = 0 AS no_nulls FROM p""")
def leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the splits, unique dates, no nulls."""
    return splits.leakage_checks(model_rows(spark, sf_dir))


@R.query(f"WITH {MODEL}, k AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n FROM p GROUP BY 1), z AS (SELECT month, n, sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) SELECT month, n FROM z WHERE coalesce(before, 0) >= 30")
def walk_forward_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with enough rows before them, and their rows."""
    rows = model_rows(spark, sf_dir)
    months = splits.month_folds(rows)
    return rows.groupBy(F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("n")).where(F.col("month").cast("string").isin(months))


PRICE_COLUMNS = ["ret_lag_0", "ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "momentum_5", "momentum_20", "volatility_20", "ma_dist_20", "dow_1", "dow_2", "dow_3", "dow_4"]


@R.query()
def logistic_price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test predictions of the price-only logistic model (l2, C = 1)."""
    return models.refit_and_predict(model_rows(spark, sf_dir), PRICE_COLUMNS, {"C": 1.0, "penalty": "l2", "class_weight": None}, "b2").select("date", "y", F.round("b2_proba", 6).alias("b2_proba"), "b2_pred")


@R.query()
def logistic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid fitted on train and judged on validation."""
    log = models.tune(model_rows(spark, sf_dir), PRICE_COLUMNS)
    return spark.createDataFrame([(r["C"], r["penalty"], r["class_weight"] or "none", r["val_accuracy"], r["val_macro_f1"]) for r in log], "C double, penalty string, class_weight string, val_accuracy double, val_macro_f1 double")


@R.query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each month that has enough rows before it, predicted from all of them."""
    rows = model_rows(spark, sf_dir)
    return models.walk_forward(rows, PRICE_COLUMNS, {"C": 1.0, "penalty": "l2", "class_weight": None}, "b2", splits.month_folds(rows))


@R.query(f"""WITH {FEATURES}, u AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS urgent, round(max(o_totalprice), 6) AS rate_nlp FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT m.date, rate, y, coalesce(urgent, 0) AS urgent, coalesce(rate_nlp, 0) AS rate_nlp FROM m LEFT JOIN u USING (date) WHERE row >= 20 AND y IS NOT NULL""")
def modeling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows with features of the urgent orders of the date, whose rate gets a suffix; 0 without any."""
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).groupBy(day("o_orderdate").alias("date"))
    joined = features.modeling_table(features.price_features(series(spark, sf_dir)), urgent.agg(F.count("*").alias("urgent"), F.round(F.max("o_totalprice"), 6).alias("rate")))
    return features.modeling_rows(joined).select("date", "rate", "y", "urgent", "rate_nlp")


_BOTH = f"""{MODEL}, g AS (SELECT avg(y) AS s FROM p WHERE split = 'train'), c AS (SELECT y, CAST((SELECT s FROM g) >= 0.5 AS INT) AS p0, CAST(ret > 0 AS INT) AS p1 FROM p WHERE split = 'test'),
l AS (SELECT 0 AS place, 'b0' AS model, y, p0 AS q FROM c UNION ALL SELECT 1, 'b1', y, p1 FROM c),
e AS (SELECT place, model, count(*) AS n, count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 0) AS tn, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn FROM l GROUP BY 1, 2),
j AS (SELECT place, model, {METRICS} FROM e)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both baselines on the test split, with their metrics."""
    rows = splits.baselines(model_rows(spark, sf_dir)).where("split = 'test'")
    long = rows.select("y", F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f"b{i}").alias("model"), F.col(f"b{i}_pred").alias("q")) for i in range(2)))).alias("x"))
    return stats.metrics(stats.confusion(long.select("y", "x.*"), "y", "q", ["place", "model"]))


@R.query(f"WITH {_BOTH} SELECT model AS best, accuracy FROM j ORDER BY accuracy DESC, place LIMIT 1")
def best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of the largest accuracy, the first of equal ones."""
    return rounded(stats.best_by_accuracy(judged(spark, sf_dir), "place"))


# sums of logarithms give the binomial terms; erf(x) = 2/sqrt(pi) exp(-x^2) sum 2^k x^(2k+1) / (2k+1)!!, whose terms are all positive
_CHI = "(CASE WHEN x > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * (SELECT sum(exp(2 * k * ln(2) + (2 * k + 1) * ln(x) - x * x + lgamma(k + 1) - lgamma(2 * k + 2))) FROM range(0, 400) t(k)) END)"


@R.query(f"""WITH {_BOTH}, d AS (SELECT CAST(count(*) FILTER (p1 = y AND p0 <> y) AS BIGINT) AS b, CAST(count(*) FILTER (p1 <> y AND p0 = y) AS BIGINT) AS c, CAST(count(*) FILTER (p1 = y) AS BIGINT) AS hits, count(*) AS n FROM c),
v AS (SELECT *, b + c AS m, abs(abs(b - c) - 1) / sqrt(2.0 * greatest(b + c, 1)) AS x, greatest((SELECT s FROM g), 1 - (SELECT s FROM g)) AS rate FROM d),
h AS (SELECT b, c, hits, n, CASE WHEN m = 0 THEN 1 WHEN m < 25 THEN least(1, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2))) FROM range(0, 25) t(k) WHERE k <= least(b, c))) WHEN x = 0 THEN 1 ELSE {_CHI} END AS mcnemar_p,
 least(1, (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate))) FROM range(0, 100000) t(k) WHERE k BETWEEN hits AND n)) AS binomial_p FROM v),
w AS (SELECT max(accuracy) FILTER (place = 1) > max(accuracy) FILTER (place = 0) AND max(macro_f1) FILTER (place = 1) > max(macro_f1) FILTER (place = 0) AS better FROM j)
SELECT b, c, hits, n, round(mcnemar_p, 6) AS mcnemar_p, round(binomial_p, 6) AS binomial_p, CASE WHEN better AND mcnemar_p < 0.05 THEN 'improves' WHEN better THEN 'inconclusive' ELSE 'no_improvement' END AS decision FROM h, w""")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence against the majority: paired test, binomial tail against the majority's rate, decision."""
    rows = splits.baselines(model_rows(spark, sf_dir))
    test = rows.where("split = 'test'")
    b, c = stats.discordant(test, "y", "b1_pred", "b0_pred").head()
    rate = rows.where("split = 'train'").agg(F.avg("y")).head()[0]
    first, second = judged(spark, sf_dir).orderBy("place").collect()
    hits, n, p = second["tp"] + second["tn"], second["n"], stats.mcnemar_p(b, c)
    verdict = stats.decision(second["accuracy"], first["accuracy"], second["macro_f1"], first["macro_f1"], p)
    made = [(b, c, hits, n, p, stats.binomial_p(hits, n, max(rate, 1 - rate)), verdict)]
    return rounded(spark.createDataFrame(made, "b long, c long, hits long, n long, mcnemar_p double, binomial_p double, decision string"))
