from datetime import UTC, date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.functions import text, urls, values


def col(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(f(F.col("v"))).collect()]


def test_titles(spark):
    assert col(spark, ["  Café \n two ", None, ""], text.clean_title) == ["Café two", "", ""]
    strip = lambda c: text.strip_prefixes(c, ["Daily Open:", "Watch:", "Daily"])
    assert col(spark, ["daily open: WATCH: Rupiah", "Dailyx", "none"], strip) == ["Rupiah", "x", "none"]


def test_keyword_boundaries(spark):
    rows = ["An award for military service", "An award ceremony", "waré", "the war.", "ASSET\n freeze", None]
    assert col(spark, rows, lambda c: text.has_keyword(c, "war")) == [False, False, False, True, False, False]
    assert col(spark, rows, lambda c: text.has_keyword(c, "asset freeze"))[4] is True
    taxonomy = {"armed_conflict": ["war", "military"], "sanctions": ["sanctions", "asset freeze"]}
    got = col(spark, ["Military sanctions and an asset freeze", "An award"], lambda c: text.match_taxonomy(c, taxonomy))
    assert got == [{"armed_conflict": ["military"], "sanctions": ["sanctions", "asset freeze"]}, {}]


@pytest.mark.parametrize("bad", [{}, {"a": {"keywords": []}}, {"a": {"keywords": "x"}}, {"a": {"keywords": [" "]}}, {"": ["x"]}, []])
def test_taxonomy_is_checked(bad):
    with pytest.raises(ValueError):
        text.validate_taxonomy(bad)


def test_decode_list(spark):
    rows = ['["a","b"]', "plain", "", None, "[broken"]
    assert col(spark, rows, text.decode_list) == [["a", "b"], ["plain"], [], [], ["[broken"]]
    assert col(spark, rows, lambda c: text.decode_list(c, "empty"))[1] == []


def test_tracking_keys(spark):
    cases = {
        "https://a.com/x?utm_source=1&b=2#f": "https://a.com/x?b=2#f", "https://a.com/x?UTM_Source=1": "https://a.com/x", "https://a.com/x?": "https://a.com/x?",
        "https://a.com/x?b=%7E&b=2&utm_idx=3": "https://a.com/x?b=%7E&b=2&utm_idx=3", "HTTP://A.com:80/": "HTTP://A.com:80/", "ftp://a.com": None, "https://a.com/%zz": None,
        "https://a b.com": None, "": None, None: None, "https://a.com:99999/": None, "https://a.com:x/": None, "https://.a.com/": None, " https://a.com ": "https://a.com", "https:///x": None,
    }
    assert col(spark, list(cases), urls.without_tracking) == list(cases.values())


def test_canonical_url_and_date(spark):
    f = lambda c: urls.canonical_url(c, ["news.org", "www.news.org"], "www.news.org")
    assert col(spark, ["http://news.org/2024/01/02/a.html?x=1#y", "https://evil.org/2024/", "https://news.org", None], f) == ["https://www.news.org/2024/01/02/a.html", None, None, None]
    rows = ["https://a.org/2024/01/02/a.html", "https://a.org/advertorial/2024/02/03/a/b.html", "https://a.org/2024/13/02/a.html", "https://a.org/2024/01/02/a", None]
    assert col(spark, rows, urls.date_in_url) == [date(2024, 1, 2), date(2024, 2, 3), None, None, None]
    assert col(spark, ["https://a.org/one-two_three/c%C3%A9+d.html", "https://a.org/%zz"], urls.url_words) == [" one two three cé+d.html", ""]


def test_parse_date_and_rate(spark):
    dates = {"2021-9-1": date(2021, 9, 1), "9/1/2021": date(2021, 9, 1), "'2021-09-01 00:00:00": date(2021, 9, 1), "44440": None, "13/1/2021": None, "2021-09": None, "2021-02-30": None, None: None, "2021-09-01T10:00Z": None}
    assert col(spark, list(dates), values.parse_date) == list(dates.values())
    rates = {"14,284": 14284.0, "14.284": 14284.0, "Rp 14.284,50": 14284.5, "14,284.50": 14284.5, "14 284": 14284.0, "idr14284": 14284.0, "14284,5": 14284.5, "1.5": 1.5, "-3": None, "0": None, "1,234.567,8": None, "14.284,500": None, "abc": None, "1 23": None, "inf": None, None: None}
    assert col(spark, list(rates), values.parse_rate) == list(rates.values())


def test_aware_timestamps(spark):
    got = col(spark, ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00-04:00", "2024-01-01T10:00:00", "20240101T100000Z", "x", None], lambda c: F.date_format(values.parse_compact(c), "HH:mm"))
    assert got == ["10:00", "14:00", None, "10:00", None, None]
    assert col(spark, ["2024-01-01T23:00:00-04:00", None], values.own_date) == [date(2024, 1, 1), None]


def test_split_window(spark):
    start = datetime(2024, 1, 1, tzinfo=UTC)

    def leaves(a, b):
        parts = values.split_window(a, b)
        return [(a, b)] if parts is None else [x for p in parts for x in leaves(*p)]

    day = leaves(start, start + timedelta(days=1))
    assert len(day) == 96 and all(a[1] == b[0] for a, b in zip(day, day[1:], strict=False))
    minutes = lambda n: values.split_window(start, start + timedelta(minutes=n))
    assert [b - a for a, b in minutes(45)] == [timedelta(minutes=15), timedelta(minutes=30)] and minutes(29) is None
    n = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-02 00:07:00' b").select(values.window_leaves(F.col("a"), F.col("b")).alias("l")).head().l
    assert len(n) == 96 and n[-1].end - n[-1].start == timedelta(minutes=22)


def test_padded_window():
    zone = timezone(timedelta(hours=7))
    start, end = datetime(2024, 1, 1, 7, tzinfo=zone), datetime(2024, 1, 1, 8, tzinfo=zone)
    assert values.padded_window(start, end) == ("20231231235959", "20240101010001")
    assert values.padded_window(start, end, 0) == ("20240101000000", "20240101010000")
    for bad in [(start, start + timedelta(minutes=14)), (end, start), (start.replace(tzinfo=None), end), (start, end, -1), (start, end, 1.5)]:
        with pytest.raises(ValueError):
            values.padded_window(*bad)


def test_build_query():
    assert values.build_query(["war", "trade  deal", "us-china"], "News.org") == '(war OR "trade deal" OR "us-china") domain:news.org sourcelang:english'
    for bad in (["OR"], ['a"b'], [], "war", ["a(b"], ["a\x01"]):
        with pytest.raises(ValueError):
            values.build_query(bad, "news.org")
    with pytest.raises(ValueError):
        values.build_query(["war"], "https://news.org")
