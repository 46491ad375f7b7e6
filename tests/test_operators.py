import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import calendar as cal
from tideline.operators import dedup, envelopes, features, models, sampling, splits, stats, taxonomy
from tideline.plans import prices

D = date.fromisoformat


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([(D("2021-09-02"), 14281.0), (D("2021-09-03"), 14261.0), (D("2021-09-06"), 14239.0), (D("2021-09-07"), 14195.0)], "date date, rate double")


def test_strict_alignment(spark, rates):
    cases = {
        "before": ("2021-09-03T07:59:00Z", "2021-09-03", "same_day_before_cutoff"), "after": ("2021-09-03T08:00:00Z", "2021-09-06", "after_cutoff_next_trade_day"),
        "saturday": ("2021-09-04T03:00:00Z", "2021-09-06", "weekend_next_trade_day"), "sunday": ("2021-09-05T03:00:00Z", "2021-09-06", "weekend_next_trade_day"),
        "holiday": ("2021-09-01T03:00:00Z", "2021-09-02", "non_trading_day_next_trade_day"), "missing": ("", None, "missing_exact_timestamp_unaligned"),
        "beyond": ("2021-09-07T09:00:00Z", None, "beyond_calendar_unaligned"),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id string, ts string")
    got = {r.id: r for r in cal.align_strict(rows, rates, cal.local_time(F.col("ts"), "Asia/Jakarta")).collect()}
    assert len(got) == len(cases)
    for k, (_, day, reason) in cases.items():
        assert (str(got[k].effective_date) if got[k].effective_date else None, got[k].alignment_reason) == (day, reason)
    moved = {r.date: r for r in cal.with_changes(rates).collect()}
    assert moved[D("2021-09-06")].previous_rate == 14261 and moved[D("2021-09-06")].change == -22


def test_lenient_alignment(spark, rates):
    full = rates.union(spark.createDataFrame([(D("2021-09-01"), 14284.0)], rates.schema))
    cases = [
        ("a", None, "2021-09-04", "2021-09-06", "date_only_next_trading_day", 2), ("b", "2021-09-01T08:59:00Z", None, "2021-09-01", "same_trading_day", 0),
        ("c", "2021-09-01T09:00:00Z", None, "2021-09-02", "after_market_close", 1), ("d", "2021-09-03T10:00:00Z", None, "2021-09-06", "after_market_close_next_trading_day", 3),
        ("e", None, None, None, "invalid_or_missing_publication_time", None), ("f", None, "2021-09-08", None, "beyond_calendar_range", None),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "id string, ts string, day string")
    got = {r.id: r for r in cal.align_lenient(rows, full, cal.local_time(F.col("ts"), "Asia/Jakarta"), F.col("day").try_cast("date")).collect()}
    for i, _, _, day, reason, lag in cases:
        r = got[i]
        assert (str(r.effective_date) if r.effective_date else None, r.alignment_reason, r.lag_days) == (day, reason, lag)


def test_alignment_never_goes_back(spark, rates):
    rows = spark.range(200).select("id", F.timestamp_seconds(F.lit(1630281600) + F.col("id") * 3571).alias("t"))
    got = cal.align_strict(rows, rates, F.col("t")).where("effective_date is not null")
    assert got.where(F.col("effective_date") < F.greatest(F.to_date("t"), F.lit("2021-09-02").cast("date"))).count() == 0


def test_calendar_is_validated(spark, rates):
    cal.validate_calendar(rates)
    for bad in ([(D("2021-09-02"), float("inf"))], [(D("2021-09-02"), 1.0)] * 2, [(None, 1.0)], []):
        with pytest.raises(ValueError):
            cal.validate_calendar(spark.createDataFrame(bad, rates.schema))
    with pytest.raises(ValueError):
        cal.cutoff_seconds(F.col("d"), "15:00", [("2024-01-01", "2024-01-05", "14:00"), ("2024-01-05", "2024-01-06", "13:00")])


TAX = {"armed_conflict": {"keywords": ["war", "military"]}, "sanctions": {"keywords": ["sanctions", "asset freeze"]}}


def test_classify(spark):
    rows = spark.createDataFrame([(1, "Military sanctions and an asset freeze", [], ""), (2, "A talk", ["War"], ""), (3, "A talk", [], "World Politics"), (4, "An award", [], "Tech"), (5, None, None, None)], "id int, title string, tags array<string>, section string")
    got = {r.id: r for r in taxonomy.classify(rows, TAX, ["politics"], tags=F.col("tags"), section=F.col("section")).collect()}
    assert got[1].matched_categories == ["armed_conflict", "sanctions"] and got[1].filter_score == 9 and got[1].filter_reason == "title_keyword_match"
    assert got[2].filter_reason == "publisher_keyword_match" and got[2].filter_score == 2 and got[2].is_candidate
    assert got[3].filter_reason == "section_prior_only_insufficient" and not got[3].is_candidate and got[3].filter_score == 1
    assert got[4].filter_reason == "no_taxonomy_match" and got[5].filter_reason == "no_taxonomy_match"


def test_prefilter_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", "award-smartwatch", "https://n.org/award-smartwatch.html"), ("b", "x", "https://n.org/trade-war/z.html"), ("c", "Tariffs", "https://n.org/y.html")], "article_id string, title string, normalized_url string")
    got = {r.article_id: r for r in taxonomy.prefilter(rows, TAX, {"sanctions": ["tariffs"]}).collect()}
    assert not got["a"].prefilter_candidate and got["b"].prefilter_reason == "url_path_taxonomy_match" and got["c"].prefilter_reason == "title_config_addition_match"
    assert taxonomy.candidates(taxonomy.prefilter(rows, TAX)).count() == 1


def feed(spark, order):
    base = [("https://a.org/x?utm_source=1", "Title", "20240103T000000Z", None, "en", "c2"), ("https://a.org/x", "", "20240101T000000Z", "a.org", "", "c1"), ("https://a.org/x", "Other", "bad", "z.org", "de", "c1"), ("nonsense", "T", "", None, None, None)]
    return spark.createDataFrame([base[i] for i in order], "url string, title string, seendate string, domain string, language string, query_category string")


def test_feed_merge_is_order_independent(spark):
    cols = ["url", "title", "seendate", "domain", "language", "query_category"]
    runs = [[r.asDict(recursive=True) for r in dedup.merge_feed(dedup.clean_feed(feed(spark, o)), cols).collect()] for o in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1])]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 1
    row = runs[0][0]
    assert row["title"] == "Title" and row["domain"] == "a.org" and row["language"] == "en" and row["source_record_count"] == 3
    assert row["categories"] == ["c1", "c2"] and row["quality_flags"] == ["invalid_timestamp", "missing_title"] and row["published_at_utc"] == datetime(2024, 1, 1)
    assert dedup.clean_feed(feed(spark, [0, 1, 2, 3])).where("disposition = 'quarantined'").count() == 1


def test_archive_dispositions(spark):
    rows = spark.createDataFrame(
        [("https://n.org/2024/01/02/a.html", "A", "2024-01-02"), ("https://n.org/2024/01/02/a.html?x", "", "2024-01-03"), ("https://other.org/2024/01/02/a.html", "B", "2024-01-02"), ("https://n.org/2023/01/02/a.html", "C", "x")],
        "url string, title string, discovered_for_date string",
    )
    got = dedup.clean_archive(rows, ["n.org"], "n.org", "2024-01-01", "2024-12-31")
    assert {r[0]: r[1] for r in got.groupBy("disposition").count().collect()} == {"kept": 2, "quarantined": 1, "excluded": 1}
    merged = dedup.merge_archive(got, ["url", "title", "discovered_for_date"]).collect()
    assert len(merged) == 1 and merged[0].title == "A" and merged[0].source_record_count == 2 and merged[0].discovered_for_dates == ["2024-01-02", "2024-01-03"]
    assert "url_date_differs_from_archive_date" in merged[0].quality_flags


def test_tone(spark):
    lex = spark.createDataFrame([("GOOD", True, False, False), ("BAD", False, True, False), ("BOTH", True, True, False), ("MAYBE", False, False, True)], "word string, is_positive boolean, is_negative boolean, is_uncertainty boolean")
    docs = spark.createDataFrame([(1, "good bad maybe both"), (2, "not good"), (3, "not aa bb good"), (4, "not aa bb cc good"), (5, "never bad"), (6, ""), (7, None)], "id int, t string")
    got = {r.id: r for r in features.tone(docs, lex, "id", F.col("t")).collect()}
    assert (got[1].lm_pos, got[1].lm_neg, got[1].lm_unc) == (0.5, 0.25, 0.25) and got[1].lm_net == 0.25
    assert got[2].lm_pos == 0 and got[2].lm_neg == 0.5 and got[3].lm_neg == 0.25 and got[4].lm_pos == 0.2 and got[5].lm_neg == 0.5
    assert got[6].n_tokens == 0 and got[7].n_tokens == 0 and not got[6].lm_has_hit
    assert all(r.litigious == 0 and r.constraining == 0 for r in got.values())


def test_tone_counts_all_marks_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    words = ["GOOD", "BAD", "SUE", "SHALL", "MAYBE", "not", "plain", "x"]
    lex = spark.createDataFrame([("GOOD", True, False, False, False, True), ("BAD", False, True, False, True, False), ("SUE", False, False, False, True, False), ("SHALL", False, False, True, False, True), ("SHALL", None, None, False, True, False), (None, True, True, True, True, True)], "word string, " + ", ".join(f"{m} boolean" for m in features.MARKS))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, "sue sue shall"), (61, None), (61, "bad")]
    docs = spark.createDataFrame(rows, "id int, t string")
    inside = features.tone(docs, lex, "id", F.col("t")).collect()
    last = next(r for r in inside if r.id == 60)
    assert (last.litigious, last.constraining, last.lm_has_hit) == (3, 1, True)
    assert [r.lm_has_hit for r in features.tone(spark.createDataFrame([(1, "sue")], "id int, t string"), lex, "id", F.col("t")).collect()] == [False]
    monkeypatch.setattr(features, "LEXICON_ROWS", 0)
    assert sorted(features.tone(docs, lex, "id", F.col("t")).collect()) == sorted(inside)


def test_daily_counts_keep_empty_days(spark, rates):
    rows = spark.createDataFrame([("a", D("2021-09-03"), ["x", "x"]), ("b", None, ["x"])], "id string, d date, matched_categories array<string>")
    got = features.daily(rows, rates, "id", "d", ["x"]).orderBy("date").collect()
    assert [r.news_count for r in got] == [0, 1, 0, 0] and [r.count_x for r in got] == [0, 1, 0, 0]


def test_sampling_is_balanced_and_stable(spark):
    rows = spark.createDataFrame([(f"id{i}", [["a", "b"][i % 2]], str(2020 + i % 3), "s") for i in range(30)], "article_id string, matched_categories array<string>, year string, section string")
    pick = lambda df: [r.article_id for r in sampling.stratified_sample(df, 12, F.col("matched_categories")[0], [F.col("year"), F.col("section")], "article_id").orderBy("sample_rank").collect()]
    first = pick(rows)
    assert first == pick(rows.orderBy(F.desc("article_id"))) and len(set(first)) == 12
    assert sum(int(x[2:]) % 2 for x in first) == 6


def test_envelopes(spark):
    rows = spark.createDataFrame([("q", 1, "completed", "p1"), ("q", 2, "failed", "p2"), ("r", 1, "failed", "p3"), ("r", 2, "completed", "p4")], "k string, attempt int, status string, path string")
    assert {(r.k, r.status) for r in envelopes.newest_attempts(rows, ["k"]).collect()} == {("q", "failed"), ("r", "completed")}
    windows = spark.createDataFrame([(0, 10, "split"), (0, 5, "completed"), (0, 3, "completed"), (5, 10, "completed"), (0, 5, "failed")], "start int, end int, status string")
    assert sorted((r.start, r.end) for r in envelopes.unblocked(windows, []).collect()) == [(0, 5), (0, 5), (0, 10), (5, 10)]
    jobs = spark.createDataFrame([(i, s) for i, s in enumerate("ffsfffsffff")], "i int, s string")
    assert [r.i for r in envelopes.circuit_breaks(jobs, "i", F.col("s") == "f", 3).collect()] == [5, 9]


def test_metrics_and_tests(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 4, "y int, p int")
    m = stats.metrics(stats.confusion(rows, "y", "p")).head()
    assert m.accuracy == pytest.approx(0.7) and m.mcc == pytest.approx((3 * 4 - 2 * 1) / np.sqrt(5 * 4 * 6 * 5))
    one = stats.metrics(stats.confusion(rows.withColumn("p", F.lit(1)), "y", "p")).head()
    assert one.mcc == 0 and one.balanced_accuracy == 0.5
    assert stats.mcnemar_p(33, 25) == pytest.approx(0.358, abs=5e-4) and stats.mcnemar_p(5, 5) == 1 and stats.mcnemar_p(0, 0) == 1
    assert stats.binomial_p(0, 5, 0.3) == pytest.approx(1) and stats.binomial_p(5, 5, 0.5) == pytest.approx(1 / 32)


def test_binomial_of_many_rows_and_best_model(spark):
    import math

    exact = lambda x, n, p: min(1.0, math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1)))
    for x, n, p in [(0, 5, 0.3), (3, 5, 0.3), (5, 5, 0.3), (200, 400, 0.52), (6, 5, 0.3), (2, 5, 0.0), (2, 5, 1.0)]:
        assert stats.binomial_p(x, n, p) == pytest.approx(exact(x, n, p), abs=1e-10)
    assert stats.binomial_p(25_300, 50_000, 0.5) == pytest.approx(0.0037, abs=3e-4)
    judged = spark.createDataFrame([(2, "b", 0.7), (1, "a", 0.7), (0, "z", 0.6), (3, "n", None), (4, "q", float("nan"))], "place int, model string, accuracy double")
    assert [tuple(r) for r in stats.best_by_accuracy(judged, "place").collect()] == [("a", 0.7)]
    assert [tuple(r) for r in stats.best_by_accuracy(judged.limit(0), "place").collect()] == [(None, None)]


def test_tfidf_ignores_text_outside_the_fit(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma"), (3, "alpha alpha delta"), (4, "omega omega")], "id int, t string")
    fit = docs.where("id <= 3")

    def weights(all_docs):
        vocab = models.vocabulary(models.terms(fit, "id", F.col("t")), 3)
        return {(r.id, r.term): r.weight for r in models.tfidf(models.terms(all_docs, "id", F.col("t")), vocab, "id").where("id <= 3").collect()}

    a, b = weights(docs), weights(docs.withColumn("t", F.when(F.col("id") == 4, "alpha beta").otherwise(F.col("t"))))
    assert a == b and sum(w * w for (i, _), w in a.items() if i == 1) == pytest.approx(1)
    assert not any(t == "omega" for _, t in a)


def test_svd_is_orthonormal(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{x:02d}" for x in rng.integers(0, 15, 12))) for i in range(30)], "id int, t string")
    found = models.terms(docs, "id", F.col("t"), bigrams=False)
    vocab = models.vocabulary(found, 30)
    v, rows = models.truncated_svd(models.tfidf(found, vocab, "id"), "id", 4, vocab.count())
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-6) and rows.count() == 30 and (v[np.arange(4), np.abs(v).argmax(1)] > 0).all()


def test_splits_are_disjoint_and_purged(spark):
    rows = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 2).cast("int").alias("y"))
    got = {r.split: r.n for r in splits.split_summary(splits.split_rows(rows)).collect()}
    assert got == {"train": 69, "validation": 14, "test": 15, "purged": 2}


def test_walk_forward_predicts_every_month(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(prices.models, "walk_forward", lambda rows, columns, params, name, months: asked.extend(months))
    prices.walk_forward(spark, "/root/testdata/sf0.001")
    months = prices.walk_forward_months(spark, "/root/testdata/sf0.001").count()
    assert len(asked) == len(set(asked)) == months > 3


def test_logistic_grid_is_whole(spark):
    got = {(r.C, r.penalty, r.class_weight) for r in prices.logistic_grid(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 16 and {r[1] for r in got} == {"l1", "l2"} and {r[0] for r in got} == {0.01, 0.1, 1.0, 10.0}


def test_l1_penalises_the_intercept(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > -1.0).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    (model, means, spreads) = models.fit_logistic(rows, ["a", "b"], C=0.01, penalty="l1")
    assert model.intercept >= 0 and abs(model.coefficients[1]) < 1e-9
    strong, *_ = models.fit_logistic(rows, ["a", "b"], C=100.0, penalty="l1")
    assert strong.intercept > model.intercept and strong.coefficients[0] > 1
    assert models.best_of([{"accuracy": 0.5, "m": 1}, {"accuracy": 0.6, "m": 2}, {"accuracy": 0.6, "m": 3}])["m"] == 2


def test_explained_variance_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"t{rng.integers(0, 12)}" for _ in range(20))) for i in range(40)], "id int, t string")
    found = models.terms(docs, "id", F.col("t"), bigrams=False)
    vocab = models.vocabulary(found, 40)
    size = vocab.count()
    weights = models.tfidf(found, vocab, "id")
    v, rows = models.truncated_svd(weights, "id", 3, size)
    x = np.zeros((40, size))
    for r in weights.collect():
        x[r.id, r.idx] = r.weight
    want = (x @ v.T).var(0) / x.var(0).sum()
    assert np.allclose(models.explained_variance(rows, weights, "id", 3), want)
