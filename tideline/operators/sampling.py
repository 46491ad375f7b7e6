"""Deterministic stratified samples by round-robin, without a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(id_col: str, seed: int) -> Column:
    """SHA-256 of "seed:id"."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def _turn(rows: DataFrame, stratum: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)))


def stratified_sample(rows: DataFrame, n: int, group: Column, strata: Sequence[Column], id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows: groups take turns in their order; inside a group its strata take turns in theirs; inside a stratum
    rows come by stable_key, ties by id. Adds sample_rank from 1. Only the first n rows of each stratum and group can be
    picked; ranks over them are cut early."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive whole number")
    names = [f"__s{k}" for k in range(len(strata))]
    staged = rows.withColumn("__g", group).withColumns(dict(zip(names, strata, strict=True))).withColumn("__k", stable_key(id_col, seed))
    cols = [F.col(x) for x in names]
    staged = _turn(staged, [F.col("__g"), *cols], [F.col("__k"), F.col(id_col)], "__a").where(F.col("__a") <= n)
    staged = _turn(staged, [F.col("__g")], [F.col("__a"), *cols], "__b").where(F.col("__b") <= n)
    picked = staged.orderBy("__b", "__g").limit(n)
    return picked.withColumn("sample_rank", F.row_number().over(Window.orderBy("__b", "__g"))).drop("__g", "__k", "__a", "__b", *names)


def review_sample(candidates: DataFrame, rejects: DataFrame, n: int, n_rejects: int, year: Column, section: Column, reject_year: Column, id_col: str = "article_id", seed: int = 42) -> DataFrame:
    """Candidates by primary category, then (year, section); rejects by year. Returns sample_group, id, sample_rank."""
    primary = F.coalesce(F.try_element_at(F.array_sort("matched_categories"), F.lit(1)), F.lit("(uncategorized)"))
    a = stratified_sample(candidates, n, primary, [year, section], id_col, seed).select(F.lit("final_candidate").alias("sample_group"), id_col, "sample_rank")
    b = stratified_sample(rejects, n_rejects, reject_year, [], id_col, seed).select(F.lit("prefilter_reject").alias("sample_group"), id_col, "sample_rank")
    return a.unionByName(b)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; adds rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
