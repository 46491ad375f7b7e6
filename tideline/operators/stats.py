"""Classification metrics, paired tests, block bootstrap, descriptive statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, tp, tn, fp, fn of 0/1 columns; one pass."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, macro_f1, balanced_accuracy and mcc (0 where its denominator is) to the output of confusion."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = (safe(2 * tp, 2 * tp + fp + fn) + safe(2 * tn, 2 * tn + fp + fn)) / 2
    base = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns({
        "accuracy": safe(tp + tn, F.col("n").cast("double")), "macro_f1": f1, "balanced_accuracy": (safe(tp, tp + fn) + safe(tn, tn + fp)) / 2,
        "mcc": F.when(base > 0, (tp * tn - fp * fn) / base).otherwise(0.0),
    })


def discordant(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """b: only prediction ``a`` is right; c: only ``b`` is."""
    x, z = F.col(a) == F.col(y), F.col(b) == F.col(y)
    return rows.agg(F.count_if(x & ~z).alias("b"), F.count_if(~x & z).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial below 25 discordant pairs, else chi-squared with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def binomial_p(successes: int, n: int, rate: float) -> float:
    """P(X >= successes) of a binomial with the rate; terms by logarithms, so that any number of rows goes."""
    if successes <= 0:
        return 1.0
    if not 0 < rate < 1:
        return float(rate >= 1 and successes <= n)
    whole = math.lgamma(n + 1)
    term = lambda k: whole - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    return min(1.0, math.fsum(math.exp(term(k)) for k in range(successes, n + 1)))


def bootstrap_starts(spark, n: int, block: int, resamples: int, seed: int = 42) -> DataFrame:
    """(resample, block, start) of a moving-block bootstrap."""
    import numpy as np

    rng = np.random.default_rng(seed)
    k = math.ceil(n / block)
    drawn = rng.integers(0, n - block + 1, size=(resamples, k))
    return spark.createDataFrame([(r, b, int(s)) for r, row in enumerate(drawn.tolist()) for b, s in enumerate(row)], "resample int, block int, start int")


def block_bootstrap(rows: DataFrame, starts: DataFrame, block: int, n: int, value: Column, level: float = 0.95, idx: str = "idx") -> DataFrame:
    """low and high: linear quantiles over resamples of the mean of ``value`` over the resampled rows, cut to n."""
    places = starts.select("resample", F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda o: F.struct((F.col("block") * block + o).alias("at"), (F.col("start") + o).alias("__i")))).alias("x"))
    places = places.select("resample", "x.at", "x.__i").where(F.col("at") < n)
    means = places.join(rows.select(F.col(idx).cast("int").alias("__i"), value.cast("double").alias("v")), "__i").groupBy("resample").agg(F.avg("v").alias("m"))
    a = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"), F.avg("m").alias("mean"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max; quantiles are exact and linear."""
    c = F.col(column)
    return rows.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.5)).alias("q50"), F.percentile(c, F.lit(0.75)).alias("q75"), F.max(c).alias("max"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from 1, the last closed; values outside aren't counted."""
    c = F.col(column)
    bin_ = F.least(F.floor((c - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return rows.where(c.between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def frequencies(rows: DataFrame, columns: Sequence[str], missing: str = "(missing)") -> DataFrame:
    """(columns, n), most frequent first, then by the columns; nulls and empty texts as ``missing``."""
    cols = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(missing)).alias(c) for c in columns]
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def correlation(rows: DataFrame, a: str, b: Sequence[str]) -> DataFrame:
    """corr_x: Pearson correlation of ``a`` with each column x."""
    return rows.agg(*(F.corr(a, x).alias(f"corr_{x}") for x in b))


def shares(rows: DataFrame, by: Sequence[str], parts: Sequence[str], total: str) -> DataFrame:
    """share_x: summed part over summed total, per group."""
    return rows.groupBy(*by).agg(*(F.when(F.sum(total) != 0, F.sum(p) / F.sum(total)).otherwise(0.0).alias(f"share_{p}") for p in parts))


def decision(accuracy_a: float, accuracy_b: float, f1_a: float, f1_b: float, p: float, alpha: float = 0.05) -> str:
    """improves if both metrics are better and the paired test agrees, else inconclusive or no_improvement."""
    better = accuracy_a > accuracy_b and f1_a > f1_b
    return "improves" if better and p < alpha else "inconclusive" if better else "no_improvement"


def best_by_accuracy(judged: DataFrame, order: str, name: str = "model") -> DataFrame:
    """One row, the ``name`` of the largest accuracy as ``best`` and its accuracy; of equal ones that first by ``order``.
    Models without an accuracy take no part."""
    key = F.when(F.col("accuracy").isNotNull() & ~F.isnan("accuracy"), F.struct(-F.col("accuracy"), F.col(order)))
    return judged.agg(F.min_by(name, key).alias("best"), F.min_by("accuracy", key).alias("accuracy"))
