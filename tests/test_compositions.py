from datetime import UTC, date, datetime, timedelta

import pytest

from tideline import pipeline
from tideline.functions import values
from tideline.operators import features
from tideline.plans.prices import series

TAX = {"conflict": {"keywords": ["war", "military"]}, "trade": {"keywords": ["tariff"]}}


def page(time, section="World"):
    return f'<script type="application/ld+json">{{"@type":"NewsArticle","datePublished":"{time}","articleSection":"{section}","keywords":"oil, war"}}</script>'


def test_records_to_daily(spark):
    rates = spark.createDataFrame([(date(2024, 1, d), 15000.0 + d) for d in (2, 3, 4, 5)], "date date, rate double")
    url = lambda d, s: f"https://www.n.org/2024/01/{d:02d}/{s}.html"
    records = spark.createDataFrame(
        [(url(2, "a-war"), "A war", "2024-01-02"), (url(2, "a-war") + "?x=1", "A war", "2024-01-03"), (url(3, "tariff-talk"), "Talk", "2024-01-03"), (url(3, "calm"), "Calm", "2024-01-03"), ("https://evil.org/x", "war", "2024-01-03"), (url(9, "war"), "war", "2024-01-09")],
        "url string, title string, discovered_for_date string",
    )
    pages = spark.createDataFrame([(url(2, "a-war"), page("2024-01-02T07:00:00Z")), (url(3, "tariff-talk"), page("2024-01-03T09:00:00Z"))], "url string, html string")
    stages = pipeline.records_to_daily(records, pages, rates, TAX, hosts=["n.org", "www.n.org"], host="www.n.org", start="2024-01-01", end="2024-01-08")
    report = pipeline.reconcile(stages)
    assert report["agrees"] and report["rows"] == 6 and report["kept"] == 4 and report["excluded"] == 1 and report["quarantined"] == 1
    assert report["articles"] == 3 and report["candidates"] == 2 and report["aligned"] == 2
    daily = {r.date: r for r in stages["daily"].collect()}
    assert [daily[date(2024, 1, d)].news_count for d in (2, 3, 4, 5)] == [1, 0, 1, 0] and daily[date(2024, 1, 2)].count_conflict == 1
    moves = {r.effective_date: r.change for r in stages["aligned"].collect()}
    assert moves == {date(2024, 1, 2): None, date(2024, 1, 4): 1.0}
    assert sorted(r.sample_group for r in stages["review"].collect()) == ["final_candidate", "final_candidate", "prefilter_reject"]


def test_evaluate(spark):
    rates = series(spark, "/root/testdata/sf0.001")
    text = rates.select("date", (rates["rate"] % 3).cast("int").alias("news_count"), (rates["rate"] % 1).alias("mean_lm_net"), rates["rate"].alias("rate"))
    report = pipeline.evaluate(rates, text, ("B2", "M2"), {"C": (1.0,), "penalty": ("l2",), "class_weight": (None,)}, resamples=50)
    assert set(report["models"]) == {"B0", "B1", "B2", "M2"} and "rate_nlp" not in report["models"]["B2"]["features"]
    for m in report["models"].values():
        assert 0 <= m["ci"][0] <= m["accuracy"] + 0.2 and m["ci"][0] <= m["ci"][1] and 0 <= m["binomial_p"] <= 1
    assert report["models"]["M2"]["decision"] in ("improves", "inconclusive", "no_improvement") and "mean_lm_net" in report["models"]["M2"]["features"]


def test_article_features(spark):
    lex = spark.createDataFrame([("GOOD", True, False, False)], "word string, is_positive boolean, is_negative boolean, is_uncertainty boolean")
    rows = spark.createDataFrame([(1, "Watch: good news"), (2, None)], "id int, title string")
    got = {r.id: r for r in features.article_features(rows, lex, "id", "title", ["Watch:"]).collect()}
    assert got[1].normalized_title == "good news" and got[1].lm_pos == 0.5 and got[2].normalized_title == "" and got[2].n_tokens == 0


def test_plan_windows():
    start = datetime(2024, 1, 1, tzinfo=UTC)
    busy = lambda a, b: a <= start + timedelta(minutes=20) < b
    plan = values.plan_windows(start, start + timedelta(hours=1), busy)
    leaves = [w for w in plan if w[2] != "split"]
    assert leaves[0][0] == start and leaves[-1][1] == start + timedelta(hours=1) and [w[2] for w in leaves].count("saturated") == 1
    assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False))
    assert [values.backoff_seconds(k, 1, 5) for k in range(4)] == [1, 2, 4, 5]
    with pytest.raises(ValueError):
        values.split_window(start, start)
