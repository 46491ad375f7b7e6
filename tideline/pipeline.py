"""The two compositions: from collected records to daily text features, and from those to an evaluation.

Each stage is a lazy DataFrame; actions are the reports, one aggregate each, and what the caller writes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import calendar as cal
from tideline.operators import dedup, features, models, sampling, splits, stats, taxonomy
from tideline.sources import articles, sinks

PRICE = ("ret_lag_", "momentum_", "volatility_", "ma_dist_", "dow_")
#: Feature sets by model: prices; with counts; with tone; with components; all.
MODELS = {"B2": PRICE, "M1": (*PRICE, "news_count", "count_"), "M2": (*PRICE, "mean_lm_"), "M3": (*PRICE, "svd_"), "M4": (*PRICE, "news_count", "count_", "mean_lm_", "svd_")}


def records_to_daily(
    records: DataFrame, pages: DataFrame, rates: DataFrame, terms: Mapping, *, hosts: Sequence[str], host: str, additions: Mapping | None = None, priors: Sequence[str] = (),
    start: str | None = None, end: str | None = None, zone: str = "Asia/Jakarta", cutoff: str = "15:00", regimes: Sequence[tuple[str, str, str]] = (), sample: int = 100, seed: int = 42,
) -> dict[str, DataFrame]:
    """Records (url, title, discovered_for_date) and pages (url, html) to the tables of each stage: cleaned, index,
    prefiltered, enriched, classified, aligned, daily, review. ``rates`` is a validated calendar (date, rate)."""
    cal.validate_calendar(rates)
    columns = records.columns
    cleaned = dedup.clean_archive(records, hosts, host, start, end)
    index = dedup.merge_archive(cleaned, columns)
    prefiltered = taxonomy.prefilter(index, terms, additions)
    queue = taxonomy.candidates(prefiltered)
    found = articles.extract(pages.select("url", "html").withColumn("page_id", F.col("url")), zone=zone).drop("url")
    enriched = queue.join(found, queue["normalized_url"] == found["id"], "left").drop("id")
    tags = F.coalesce("keywords", F.array().cast("array<string>"))
    classified = taxonomy.classify(enriched, terms, priors, "title", tags, F.concat_ws(" | ", "section", "subsection"))
    aligned = cal.align_strict(classified.where("is_candidate"), rates, F.col("published_local"), cutoff, regimes)
    moves = cal.with_changes(rates).withColumnsRenamed({"date": "__d"})
    aligned = aligned.join(moves, aligned["effective_date"] == moves["__d"], "left").drop("__d")
    daily = features.daily(aligned, rates.select("date"), "article_id", "effective_date", sorted(terms))
    year = F.coalesce(F.date_format("published_local", "yyyy"), F.lit("(missing)"))
    section = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("(missing)"))
    review = sampling.review_sample(classified.where("is_candidate"), prefiltered.where("not prefilter_candidate"), sample, sample, year, section, F.date_format("publication_date", "yyyy"), seed=seed)
    return {"cleaned": cleaned, "index": index, "prefiltered": prefiltered, "enriched": enriched, "classified": classified, "aligned": aligned, "daily": daily, "review": review}


def reconcile(stages: Mapping[str, DataFrame]) -> dict[str, int | bool]:
    """Counts of each stage, taken on either side independently, and whether they agree."""
    kinds = sinks.qa_report(stages["cleaned"], {k: F.col("disposition") == k for k in ("kept", "quarantined", "excluded")})
    index = stages["index"].agg(F.count("*"), F.sum("source_record_count")).head()
    aligned = sinks.qa_report(stages["aligned"], {"aligned": F.col("effective_date").isNotNull()})
    daily = stages["daily"].agg(F.sum("news_count")).head()[0] or 0
    candidates = stages["classified"].where("is_candidate").count()
    return {
        **kinds, "articles": index[0], "observations": index[1] or 0, "candidates": candidates, "aligned": aligned["aligned"], "in_daily": daily,
        "agrees": kinds["rows"] == kinds["kept"] + kinds["quarantined"] + kinds["excluded"] and kinds["kept"] == (index[1] or 0) and candidates == aligned["rows"] and aligned["aligned"] == daily,
    }


def evaluate(rates: DataFrame, text: DataFrame | None = None, names: Sequence[str] = ("B2",), grid: dict | None = None, warmup: int = 20, block: int = 10, resamples: int = 500, seed: int = 42, walk: bool = False) -> dict:
    """Baselines and logistic models on the series, with daily text features if given: tuned on validation, refitted on
    train and validation, judged once on test, compared with the first model by a paired test; best names that of the
    largest accuracy among the compared ones. Returns a report of plain values; raises ValueError where a leakage check fails."""
    table = features.price_features(rates)
    if text is not None:
        table = features.modeling_table(table, text)
    rows = splits.split_rows(features.modeling_rows(table, warmup)).cache()
    checks = splits.leakage_checks(rows).head().asDict()
    if not all(checks.values()):
        raise ValueError(f"leakage checks failed: {checks}")
    report: dict = {"splits": {r["split"]: r.asDict() for r in splits.split_summary(rows).collect()}, "checks": checks, "models": {}}
    joint = splits.baselines(rows).where("split = 'test'")
    columns: dict[str, list[str]] = {}
    for name in names:
        columns[name] = models.feature_columns(table.columns, MODELS[name])
        best = models.tune(rows, columns[name], grid)[0]
        params = {k: best[k] for k in ("C", "penalty", "class_weight")}
        predicted = models.refit_and_predict(rows, columns[name], params, name.lower()).select("date", f"{name.lower()}_pred", f"{name.lower()}_proba")
        joint = joint.join(predicted, "date")
        report["models"][name] = {"params": params, "features": columns[name]}
    joint = joint.withColumn("idx", F.col("idx") - joint.agg(F.min("idx")).scalar()).cache()
    n = joint.count()
    starts = stats.bootstrap_starts(rates.sparkSession, n, min(block, n), resamples, seed)
    rate = report["splits"]["train"]["up_share"]
    for name in ("B0", "B1", *names):
        pred = f"{name.lower()}_pred"
        m = stats.metrics(stats.confusion(joint, "y", pred)).head().asDict()
        ci = stats.block_bootstrap(joint, starts, min(block, n), n, (F.col(pred) == F.col("y")).cast("double")).head()
        entry = report["models"].setdefault(name, {})
        entry |= m | {"ci": (ci["low"], ci["high"]), "binomial_p": stats.binomial_p(m["tp"] + m["tn"], n, max(rate, 1 - rate))}
    for name in names[1:]:
        d = stats.discordant(joint, "y", f"{names[0].lower()}_pred", f"{name.lower()}_pred").head()
        a, b = report["models"][name], report["models"][names[0]]
        p = stats.mcnemar_p(d["b"], d["c"])
        report["models"][name] |= {"mcnemar_p": p, "decision": stats.decision(a["accuracy"], b["accuracy"], a["macro_f1"], b["macro_f1"], p)}
    if len(names) > 1:
        report["best"] = max(names[1:], key=lambda name: report["models"][name]["accuracy"])  # the first of equal ones
    if walk:
        months = splits.month_folds(rows)
        report["walk_forward"] = [r.asDict() for name in names for r in models.walk_forward(rows, columns[name], report["models"][name]["params"], name.lower(), months).collect()]
    joint.unpersist()
    rows.unpersist()
    return report
