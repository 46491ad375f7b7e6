"""TF-IDF, truncated SVD, logistic models, grid search and walk-forward evaluation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import tokens

#: Terms up to which the components come from the Gram matrix (8 bytes a pair of terms on the driver).
GRAM_TERMS = 2000
#: Terms of a vocabulary that is broadcast, at most.
SMALL_VOCABULARY = 200_000
#: Rows of a calendar that an l1 model is fitted on, at most: they go to the driver.
PROXIMAL_ROWS = 100_000
#: The grid.
GRID = {"C": (0.01, 0.1, 1.0, 10.0), "penalty": ("l1", "l2"), "class_weight": (None, "balanced")}


def terms(docs: DataFrame, key: str, text: Column, stop_words: Sequence[str] = (), bigrams: bool = True) -> DataFrame:
    """(key, terms array<string>): of each row its lower-case words and, after the stop words are gone, pairs of
    neighbours, as often as they occur."""
    words = F.filter(F.transform(tokens(text), lambda t: F.lower(t)), lambda t: ~t.isin(*stop_words)) if stop_words else F.transform(tokens(text), lambda t: F.lower(t))
    staged = docs.select(F.col(key), words.alias("__w"))
    pairs = F.zip_with(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0))), F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    every = F.concat("__w", F.when(F.size("__w") > 1, pairs).otherwise(F.array().cast("array<string>"))) if bigrams else F.col("__w")
    return staged.select(key, every.alias("terms"))


def vocabulary(found: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, idx, idf) from the fit documents' terms: within the document-frequency bounds, at most ``max_features`` by
    corpus count, ties by term; idx in term order; idf = ln((1+n)/(1+df)) + 1. Each row's occurrences and distinct terms
    are counted where they are; only a count for each term is shuffled. Places come from a sort by ranges and the sizes
    of the ranges before, so that no task holds the whole vocabulary."""
    marked = lambda name, one: F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(1 - one).alias("cf"), F.lit(one).alias("df")))
    each = found.select(F.explode(F.concat(marked("terms", 0), marked(F.array_distinct("terms"), 1))).alias("x"))
    stats = each.groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features:
        stats = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")
    if max_features and max_features <= SMALL_VOCABULARY:
        return stats.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), idf)
    dealt = stats.repartitionByRange("term").sortWithinPartitions("term").select("term", idf, F.spark_partition_id().alias("__p")).persist()
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("__p").count().collect())  # one number for each partition
    before = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("__p")] if before else F.lit(0)
    return dealt.select("term", (start + F.row_number().over(Window.partitionBy("__p").orderBy("term")) - 1).cast("int").alias("idx"), "idf")


def tfidf(found: DataFrame, vocab: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """(key, term, idx, weight), rows of unit length. Occurrences meet the vocabulary before they are counted, so that only
    its own terms are shuffled; a vocabulary that is small goes to all executors."""
    known = vocab.persist()
    known = F.broadcast(known) if known.count() <= SMALL_VOCABULARY else known
    raw = found.select(key, F.explode("terms").alias("term")).join(known, "term").groupBy(key, "term", "idx", "idf").agg(F.count("*").alias("tf"))
    raw = raw.withColumn("w", (F.log("tf") + 1 if sublinear else F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "idx", (F.col("w") / norm).alias("weight"))


def _dense(batch, size: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, size))
    entries = batch.column(1)
    lengths = np.diff(entries.offsets.to_numpy())
    flat = entries.flatten()
    np.add.at(out, (np.repeat(np.arange(batch.num_rows), lengths), flat.field(0).to_numpy()), flat.field(1).to_numpy())
    return out


def _gram(rows: DataFrame, size: int) -> np.ndarray:
    """The Gram matrix of the rows (key, e): each task sums those of its batches, and the halves of these are added up."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                x = _dense(batch.slice(at, 1000), size)
                total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "g"])

    found = rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros((size, size))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("g").to_numpy()
    return out + np.triu(out, 1).T


def truncated_svd(weights: DataFrame, key: str, k: int, size: int, fit: DataFrame | None = None):
    """(components numpy k' x size, projected rows (key, svd array)), k' = max(1, min(k, size-1, fit rows-1)). Signs are
    fixed: the loading of largest size is positive. Fit on the keys of ``fit`` only."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = weights.groupBy(key).agg(F.collect_list(F.struct("idx", "weight")).alias("e")).persist()
    used = rows if fit is None else rows.join(fit.select(key), key, "left_semi")
    n = used.count()
    k = max(1, min(k, size - 1, n - 1))
    if size <= GRAM_TERMS:  # one pass for the Gram matrix, its eigenvectors on the driver
        v = np.linalg.eigh(_gram(used, size))[1][:, ::-1][:, :k].T
    else:  # the iterative solver goes over the rows again and again
        vectors = used.select("e").rdd.map(lambda r: Vectors.sparse(size, sorted((x.idx, x.weight) for x in r.e))).cache()
        v = RowMatrix(vectors, n, size).computeSVD(k).V.toArray().T
        vectors.unpersist()
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    if not np.isfinite(v).all():
        raise ValueError("the components aren't finite")

    def project(batches):
        for batch in batches:
            parts = [_dense(batch.slice(at, 1000), size) @ v.T for at in range(0, batch.num_rows, 1000)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(v)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(v), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "svd"])

    kind = dict(rows.dtypes)[key]
    return v, rows.mapInArrow(project, f"k {kind}, svd array<double>").withColumnRenamed("k", key)


def explained_variance(projected: DataFrame, weights: DataFrame, key: str, k: int) -> list[float]:
    """Of each component the variance of the projected rows over the variance of all weights, summed over terms."""
    n = projected.count()
    total = weights.groupBy("idx").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    total = total.agg(F.sum(F.col("q") / n - F.col("s") / n * (F.col("s") / n))).head()[0] or 0.0
    own = projected.agg(*(F.var_pop(F.col("svd")[j]) for j in range(k))).head()
    return [float(x or 0.0) / total if total else 0.0 for x in own]


def top_terms(components: np.ndarray, vocab: DataFrame, n: int = 10) -> DataFrame:
    """(component, term, loading, rank): the n largest loadings of each component."""
    spark = vocab.sparkSession
    flat = spark.createDataFrame([(j, i, float(x)) for j, row in enumerate(components) for i, x in enumerate(row)], "component int, idx int, loading double")
    w = Window.partitionBy("component").orderBy(F.desc("loading"), "term")
    return flat.join(vocab.select("term", "idx"), "idx").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("idx")


def daily_vectors(rows: DataFrame, date_col: str, k: int, calendar: DataFrame, vector: str = "svd") -> DataFrame:
    """svd_j: mean per calendar date, 0 on dates without rows."""
    means = rows.groupBy(F.col(date_col).alias("__d")).agg(*(F.avg(F.col(vector)[j]).alias(f"svd_{j}") for j in range(k)))
    return calendar.select("date").join(means, F.col("date") == F.col("__d"), "left").drop("__d").na.fill(0.0)


def feature_columns(columns: Sequence[str], parts: Sequence[str]) -> list[str]:
    """The columns whose names begin with one of the parts, in the table's order."""
    return [c for c in columns if any(c.startswith(p) for p in parts)]


class LinearModel(NamedTuple):
    """Coefficients and intercept of a model fitted here."""

    coefficients: np.ndarray
    intercept: float


def fit_logistic(rows: DataFrame, columns: Sequence[str], C: float = 1.0, penalty: str = "l2", class_weight: str | None = None, target: str = "y"):
    """A fitted pipeline: population-standardised features and logistic regression with the loss C * sum + penalty. With l2
    the intercept is free; with l1 it is penalised as the coefficients are, and the rows, a calendar of PROXIMAL_ROWS at
    most, are fitted on the driver. Returns (model, means, spreads); score with predict_logistic."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)), F.count("*").alias("n"), F.sum(target).alias("pos")).head()
    means = [float(stats[f"m{i}"]) for i in range(len(columns))]
    spreads = [float(stats[f"s{i}"]) or 1.0 for i in range(len(columns))]
    n, pos = stats["n"], float(stats["pos"] or 0)
    weight = F.lit(1.0) if class_weight is None else F.when(F.col(target) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1)))
    scaled = _scaled(rows.withColumn("__w", weight), columns, means, spreads)
    if penalty == "l1":
        if n > PROXIMAL_ROWS:
            raise ValueError(f"l1 models are fitted on {PROXIMAL_ROWS} rows at most")
        found = scaled.select(*(F.col(f"__x{i}").cast("double") for i in range(len(columns))), F.col(target).cast("double"), "__w").collect()
        x = np.array(found, np.float64).reshape(-1, len(columns) + 2)
        w = proximal_logistic(x[:, :-2], x[:, -2], C, x[:, -1])
        return LinearModel(w[:-1], float(w[-1])), means, spreads
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(columns))], outputCol="__f").transform(scaled)
    model = LogisticRegression(featuresCol="__f", labelCol=target, weightCol="__w", standardization=False, regParam=1.0 / (C * n), elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=500, tol=1e-9).fit(data)
    return model, means, spreads


def _scaled(rows: DataFrame, columns: Sequence[str], means: Sequence[float], spreads: Sequence[float]) -> DataFrame:
    return rows.withColumns({f"__x{i}": (F.col(c) - means[i]) / spreads[i] for i, c in enumerate(columns)})


def predict_logistic(rows: DataFrame, fitted, columns: Sequence[str], name: str) -> DataFrame:
    """Adds name_proba and name_pred (1 above one half): an expression, no Python on the rows."""
    model, means, spreads = fitted
    z = F.lit(float(model.intercept))
    for i, c in enumerate(columns):
        z = z + float(model.coefficients[i]) * ((F.col(c) - means[i]) / spreads[i])
    return rows.withColumn(f"{name}_proba", 1 / (1 + F.exp(-z))).withColumn(f"{name}_pred", (F.col(f"{name}_proba") > 0.5).cast("int"))


def proximal_logistic(x: np.ndarray, y: np.ndarray, C: float, weights: np.ndarray | None = None, steps: int = 60_000, tol: float = 1e-10) -> np.ndarray:
    """Coefficients, then the intercept, of l1-penalised logistic regression whose intercept is penalised, too: an
    accelerated proximal gradient method for calendars (some thousand rows) on the driver."""
    a = np.c_[x, np.ones(len(x))]
    weights = np.ones(len(y)) if weights is None else weights
    size = 1.0 / (C * 0.25 * np.linalg.norm(a * np.sqrt(weights)[:, None], 2) ** 2)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -35, 35)))
        g = v - size * C * (a.T @ (weights * (p - y)))
        new = np.sign(g) * np.maximum(np.abs(g) - size, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < tol
        w, t = new, t2
        if done:
            break
    return w


def tune(rows: DataFrame, columns: Sequence[str], grid: dict | None = None, target: str = "y") -> list[dict]:
    """The grid fitted on the train split and judged on validation, best first (accuracy, macro F1, grid order)."""
    from .stats import confusion, metrics

    grid = grid or GRID
    train, held = rows.where("split = 'train'").cache(), rows.where("split = 'validation'").cache()
    log = []
    for k, values in enumerate(itertools.product(*grid.values())):
        params = dict(zip(grid, values, strict=True))
        fitted = fit_logistic(train, columns, target=target, **params)
        row = metrics(confusion(predict_logistic(held, fitted, columns, "m"), target, "m_pred")).head()
        log.append(params | {"val_accuracy": row["accuracy"], "val_macro_f1": row["macro_f1"], "order": k})
    train.unpersist()
    held.unpersist()
    return sorted(log, key=lambda r: (-r["val_accuracy"], -r["val_macro_f1"], r["order"]))


def best_of(log: Sequence[dict], by: str = "accuracy") -> dict:
    """The entry with the largest value; of equal ones the first."""
    return max(log, key=lambda r: r[by])


def refit_and_predict(rows: DataFrame, columns: Sequence[str], params: dict, name: str) -> DataFrame:
    """Test rows with predictions of a model fitted on train and validation."""
    fitted = fit_logistic(rows.where("split in ('train', 'validation')"), columns, **params)
    return predict_logistic(rows.where("split = 'test'"), fitted, columns, name)


def coefficients(fitted, columns: Sequence[str]) -> dict[str, float]:
    """By feature, and intercept."""
    return dict(zip(columns, map(float, fitted[0].coefficients), strict=True)) | {"intercept": float(fitted[0].intercept)}


def newton_logistic(x: np.ndarray, y: np.ndarray, C: float, weights: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Coefficients, then the free intercept, of l2-penalised logistic regression (C * sum + half the squares), for
    calendars on the driver: Newton steps, halved until the loss falls."""
    a = np.c_[x, np.ones(len(x))]
    weights = np.ones(len(y)) if weights is None else weights
    ridge = np.append(np.ones(x.shape[1]), 1e-12)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return C * float(weights @ (np.logaddexp(0, z) - y * z)) + float(ridge @ (w * w)) / 2

    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = C * (a.T @ (weights * (p - y))) + ridge * w
        step = np.linalg.solve(C * (a.T @ (a * (weights * p * (1 - p))[:, None])) + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-11:
            break
    return w


def walk_forward(rows: DataFrame, columns: Sequence[str], params: dict, name: str, months: Sequence[str], date_col: str = "date", target: str = "y") -> DataFrame:
    """(month, model_id, n_days, accuracy): each month predicted by a model fitted on all rows before it. The rows are a
    calendar, PROXIMAL_ROWS at most, read once and fitted on the driver as fit_logistic does."""
    kind = "month string, model_id string, n_days long, accuracy double"
    found = rows.select(F.col(date_col).cast("date"), F.col(target).cast("double"), *(F.col(c).cast("double") for c in columns)).limit(PROXIMAL_ROWS + 1).collect()
    if len(found) > PROXIMAL_ROWS:
        raise ValueError(f"a calendar has {PROXIMAL_ROWS} rows at most")
    begins = np.array([r[0].strftime("%Y-%m-01") for r in found])
    y, x = np.array([r[1] for r in found]), np.array([list(r[2:]) for r in found], np.float64).reshape(len(found), -1)
    out = []
    for month in months:
        before, held = begins < month, begins == month
        if not held.any() or not before.any():
            continue
        mean, spread = x[before].mean(0), x[before].std(0)
        spread[spread == 0] = 1.0
        n, pos = int(before.sum()), float(y[before].sum())
        weights = np.ones(n) if params.get("class_weight") is None else np.where(y[before] == 1, n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1)))
        solve = proximal_logistic if params.get("penalty") == "l1" else newton_logistic
        w = solve((x[before] - mean) / spread, y[before], params.get("C", 1.0), weights)
        predicted = (x[held] - mean) / spread @ w[:-1] + w[-1] > 0
        out.append((month[:7], name, int(held.sum()), float((predicted == (y[held] == 1)).mean())))
    return rows.sparkSession.createDataFrame(out, kind)
