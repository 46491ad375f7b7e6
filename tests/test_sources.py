import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.operators import features
from tideline.sources import articles, config, envelopes, sinks, tables

LD = '<script type="application/ld+json">{"@graph":[{"@type":"Article","datePublished":"2020-01-01T00:00:00Z"},{"@type":["NewsArticle"],"datePublished":"2024-05-01T10:00:00+07:00","articleSection":"World","keywords":"war, oil","headline":"H","author":[{"name":"A B"}]}]}</script>'


@pytest.mark.parametrize(
    ("html", "published", "source", "section", "section_source"),
    [
        (LD + '<meta property="article:published_time" content="2024-01-01T00:00:00Z">', "2024-05-01T10:00:00+07:00", "jsonld.datePublished", "World", "jsonld.articleSection"),
        ('<meta property="article:published_time" content="2024-01-01T00:00:00Z"><meta name="section" content="Oil">', "2024-01-01T00:00:00Z", "meta.article:published_time", "Oil", "meta.section"),
        ('<script>window.__s = {"page":{"publishedDate":"2024-01-01T00:00:00+0000","sectionName":"Tech"}};</script>', "2024-01-01T00:00:00+0000", "structured.publishedDate", "Tech", "structured.sectionName"),
        ('<p>Published <time datetime="2024-02-02T01:00:00Z">x</time></p><p>Updated <time datetime="2024-03-03T01:00:00Z">', "2024-02-02T01:00:00Z", "rendered.time.datetime", "markets", "canonical_url_path_fallback"),
        ('<meta property="article:published_time" content="2024-01-01T00:00:00">', None, None, "markets", "canonical_url_path_fallback"),
        ('<meta name="pubdate" content="2024-03-03T00:00:00Z"><meta property="article:published_time" content="2024-01-01T00:00:00Z">', "2024-03-03T00:00:00Z", "meta.pubdate", "markets", "canonical_url_path_fallback"),
        ('<meta name="PubDate" content="2024-03-03"><meta property="og:article:published_time" content="2024-01-01T00:00:00Z">', "2024-01-01T00:00:00Z", "meta.og:article:published_time", "markets", "canonical_url_path_fallback"),
        ('<script>a.b = {"published_at":"2024-01-02T00:00:00Z","x":{"datePublished":"2024-01-01T00:00:00Z","Section":"S"}};</script>', "2024-01-02T00:00:00Z", "structured.published_at", "S", "structured.Section"),
        ('<script>a.b = {"published_at":"2024-01-02","datePublished":"2024-01-01T00:00:00Z"};</script>', None, None, "markets", "canonical_url_path_fallback"),
        ("", None, None, "markets", "canonical_url_path_fallback"),
        ('<script type="application/ld+json">{broken</script><p><b>unclosed', None, None, "markets", "canonical_url_path_fallback"),
    ],
)
def test_metadata_hierarchy(html, published, source, section, section_source):
    got = articles.metadata(html, "https://n.org/markets/2024/x.html")
    assert (got["published"], got["timestamp_source"], got["section"], got["section_source"]) == (published, source, section, section_source)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "https://n.org/2024/x", LD), (2, None, None)], "page_id int, url string, html string")
    got = {r.id: r for r in articles.extract(pages).collect()}
    assert got[1].timestamp_status == "exact_publisher_timestamp" and got[1].published_at_utc.hour == 3 and got[1].published_local.hour == 10
    assert got[1].keywords == ["oil", "war"] and got[1].categories == ["oil", "war", "World"] and got[1].authors == ["A B"]
    assert got[2].timestamp_status == "missing_publisher_timestamp" and got[2].section is None


def test_embedded_json():
    text = 'x window.__state = {"a":{"total":1,"items":[1]}}; window.__state = nope'
    assert articles.embedded_json(text, "window.__state") == [{"a": {"total": 1, "items": [1]}}]
    assert articles.find_payload(articles.embedded_json(text, "window.__state"), {"total", "items"})["total"] == 1
    for bad in ([], [{"total": 1, "items": []}, {"total": 2, "items": []}]):
        with pytest.raises(ValueError):
            articles.find_payload(bad, {"total", "items"})


def workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{"ABCDEF"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{"ABCDEF"[c]}{r}" s="1"><v>{v}</v></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i + 1, c, v) for c, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    path = tmp_path / "rates.xlsx"
    workbook(path, [["Report"], [None], [None, "NO", " Tanggal ", "KURS"], [None, "1", 44440, "14.284,00"], [None, None, None, None], [None, "2", "9/2/2021", "14,281"]])
    assert tables.locate(str(tmp_path)) == path
    cells = tables.extract_table(tables.read_workbook(str(path)), ["tanggal", "kurs"])
    assert [c[0] for c in cells] == [4, 6]
    df = spark.createDataFrame(cells, "source_row int, date_raw string, rate_raw string")
    assert sorted(map(tuple, tables.clean_rates(df).collect())) == [(date(2021, 9, 1), 14284.0), (date(2021, 9, 2), 14281.0)]
    for bad in ([("x",)], [("tanggal", "kurs"), ("tanggal", "kurs")]):
        with pytest.raises(ValueError):
            tables.extract_table({"S": bad}, ["tanggal", "kurs"])
    workbook(tmp_path / "two.xlsx", [])
    with pytest.raises(ValueError):
        tables.locate(str(tmp_path))


def test_rate_problems(spark):
    rows = [(1, "2021-09-01", "1"), (2, "2021-09-01", "2"), (3, "", "3"), (4, "x", "4"), (5, "2021-09-02", None), (6, "2021-09-03", "-1"), (7, "2021-09-04", "7")]
    df = spark.createDataFrame(rows, "source_row int, date_raw string, rate_raw string")
    got = {r.source_row: r.problem for r in tables.parse_rates(df).collect()}
    assert got == {1: "duplicate_date", 2: "duplicate_date", 3: "missing_date", 4: "invalid_date", 5: "missing_rate", 6: "invalid_rate", 7: None}
    with pytest.raises(ValueError, match="row 1: duplicate_date"):
        tables.clean_rates(df)
    assert sorted(map(tuple, tables.clean_rates(df, strict=False).collect())) == [(date(2021, 9, 1), 1.0), (date(2021, 9, 4), 7.0)]


def test_csv_and_ranges(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"two ""q"" lines\nhere"\n2,\n')
    assert [r.t for r in tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string", keep_empty=True).orderBy("id").collect()] == ['two "q" lines\nhere', ""]
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), ["id", "x"])
    tables.check_range(date(2024, 1, 1), date(2024, 1, 31), 31)
    for a, b, n, bounds in [("2024-01-02", "2024-01-01", 9, None), ("2024-01-01", "2024-02-01", 31, None), ("2024-01-01", "2024-01-02", 9, (date(2024, 1, 2), date(2025, 1, 1)))]:
        with pytest.raises(ValueError):
            tables.check_range(date.fromisoformat(a), date.fromisoformat(b), n, bounds)


def test_archive_envelopes(spark, tmp_path):
    def put(name, day, attempt, status, urls):
        (tmp_path / name).write_text(json.dumps({"archive_date": day, "attempt": attempt, "status": status, "reported_total_count": 2, "pages": 2, "records": [{"url": u, "title": "t"} for u in urls]}, indent=1))

    put("a1.json", "2024-01-01", 1, "completed", ["u1", "u2"])
    put("a2.json", "2024-01-01", 2, "failed", [])
    put("b1.json", "2024-01-02", 1, "failed", [])
    put("b2.json", "2024-01-02", 2, "completed", ["u3", "u3"])
    put("c1.json", "2024-02-02", 1, "completed", ["u9", "u8"])
    found = envelopes.read_envelopes(spark, str(tmp_path), envelopes.ARCHIVE)
    assert sorted(r.url for r in envelopes.archive_records(found, "2024-01-01", "2024-01-31").collect()) == ["u3", "u3"]
    from tideline.operators.envelopes import integrity

    assert {(str(r.archive_date), r.attempt): r.intact for r in integrity(found).collect()} == {("2024-01-01", 1): True, ("2024-01-01", 2): False, ("2024-01-02", 1): False, ("2024-01-02", 2): False, ("2024-02-02", 1): True}


def test_feed_envelopes(spark, tmp_path):
    def put(name, start, end, attempt, status, urls):
        who = {"query": "q", "topic": "t", "domain": "d", "logical_start": f"2024-01-01T{start}:00:00Z", "logical_end": f"2024-01-01T{end}:00:00Z", "api_config": "c"}
        (tmp_path / name).write_text(json.dumps({"identity": who, "attempt": attempt, "status": status, "records": [{"url": u} for u in urls]}))

    put("day.json", "00", "12", 1, "split", [])
    put("left1.json", "00", "06", 1, "completed", ["old"])
    put("left2.json", "00", "06", 2, "completed", ["new"])
    put("child.json", "00", "03", 1, "completed", ["blocked"])
    put("right.json", "06", "12", 1, "completed", ["right"])
    found = envelopes.read_envelopes(spark, str(tmp_path), envelopes.FEED)
    assert sorted(r.url for r in envelopes.feed_records(found).collect()) == ["new", "right"]
    assert envelopes.saturated(found, 1).where("saturated").count() == 4


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "kept", ["a"]), (2, "excluded", []), (3, "kept", None)], "id int, disposition string, tags array<string>")
    assert sinks.write_dispositions(rows, str(tmp_path / "d")) == {"kept": 2, "quarantined": 0, "excluded": 1}
    assert spark.read.parquet(str(tmp_path / "d/kept")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_dispositions(rows.withColumn("disposition", F.lit("x")), str(tmp_path / "e"))
    assert sinks.qa_report(rows, {"tagged": F.size("tags") > 0}) == {"rows": 3, "tagged": 1}
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert {r.tags for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()} == {'["a"]', "[]", None}
    for a, b in [("x", "x"), ("x", "x/y")]:
        with pytest.raises(ValueError):
            sinks.distinct_paths(str(tmp_path / a), str(tmp_path / b))
    sinks.distinct_paths(str(tmp_path / "x"), str(tmp_path / "y"))
    m = sinks.Manifest(str(tmp_path / "m.json"), a=1)
    assert m.stage("one", lambda: 5) == 5
    with pytest.raises(ZeroDivisionError):
        m.stage("two", lambda: 1 / 0)
    saved = json.loads((tmp_path / "m.json").read_text())
    assert saved["status"] == "failed" and saved["stages"]["one"]["status"] == "completed" and saved["stages"]["two"]["error"]
    before = sinks.sha256_file(str(tmp_path / "m.json"))
    assert before == sinks.sha256_file(str(tmp_path / "m.json"))


def test_output_of_a_source(tmp_path):
    source, out, report = (str(tmp_path / n) for n in ("in.csv", "out.csv", "r.json"))
    (tmp_path / "in.csv").write_text("1\n")
    saved = lambda: json.loads((tmp_path / "r.json").read_text())
    assert sinks.from_source(source, out, report, lambda s, o: {"n": (tmp_path / "out.csv").write_text("2\n")})["output_valid"]
    assert saved()["status"] == "passed" and saved()["n"] == 2 and (tmp_path / "out.csv").exists()

    def fails(s, o):
        assert not (tmp_path / "out.csv").exists() and saved()["status"] == "running"
        (tmp_path / "out.csv").mkdir()
        (tmp_path / "out.csv/part").write_text("half")
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        sinks.from_source(source, out, report, fails)
    assert saved()["status"] == "failed" and not saved()["output_valid"] and not (tmp_path / "out.csv").exists()
    with pytest.raises(ValueError, match="changed"):
        sinks.from_source(source, out, report, lambda s, o: (tmp_path / "out.csv").write_text("2") and (tmp_path / "in.csv").write_text("3") and None)
    assert not (tmp_path / "out.csv").exists()
    with pytest.raises(ValueError, match="overlap"):
        sinks.from_source(source, source, report, fails)


def test_split_export(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{i}", i, s, i % 2) for i, s in enumerate(["train", "train", "purged", "validation", "purged", "test"], 1)], "date string, x int, split string, y int")
    with pytest.raises(ValueError):
        sinks.export_splits(rows, str(tmp_path / "s"), expected={"train": 3, "validation": 1, "test": 1})
    assert not (tmp_path / "s").exists()
    got = sinks.export_splits(rows, str(tmp_path / "s"), str(tmp_path / "s.json"), expected={"train": 2, "validation": 1, "test": 1})
    assert got == json.loads((tmp_path / "s.json").read_text()) and got["purged_dates"] == ["2024-01-03", "2024-01-05"] and got["columns"] == ["date", "x", "y"]
    assert got["splits"]["train"] == {"rows": 2, "start_date": "2024-01-01", "end_date": "2024-01-02", "share_positive": 0.5} and "purged" not in got["splits"]
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6


def test_bounded_settings():
    assert config.bounded({"a": 3}, "a", 1, 1, 5, whole=True) == 3 and config.bounded({}, "a", 2, 1) == 2.0
    for bad in (True, "3", 0, 6, float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            config.bounded({"a": bad}, "a", 1, 1, 5)
    with pytest.raises(ValueError):
        config.bounded({"a": 2.5}, "a", 1, 1, 5, whole=True)


def test_settings(tmp_path):
    if config.yaml is None:
        pytest.skip("no YAML here")
    (tmp_path / "c.yaml").write_text("a: 1\n")
    (tmp_path / "t.yaml").write_text("oil_gas: {keywords: [oil]}\n")
    assert config.load_settings(str(tmp_path / "c.yaml"), str(tmp_path / "t.yaml")) == ({"a": 1}, {"oil_gas": {"keywords": ["oil"]}})
    for text in ("{}\n", "'a b': {keywords: [x]}\n", "__: {keywords: [x]}\n", "a: {keywords: x}\n", "a: [x]\n", "1: {keywords: [x]}\n"):
        (tmp_path / "t.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.load_settings(str(tmp_path / "c.yaml"), str(tmp_path / "t.yaml"))


def test_config(tmp_path):
    if config.yaml is None:
        pytest.skip("no YAML here")
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert config.load_config(str(tmp_path / "c.yaml"), ["a"]) == {"a": 1}
    for text, need in [("- 1\n", []), ("a: 1\n", ["b"])]:
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.load_config(str(tmp_path / "c.yaml"), need)


def test_stream_equals_batch(spark, tmp_path):
    from tideline.operators.calendar import align_strict
    from tideline.streaming.align import align_stream, daily_stream

    rows = spark.range(300).select(F.col("id"), F.timestamp_seconds(F.lit(1704153600) + F.col("id") * 5021).alias("t"))
    cal = spark.createDataFrame([(date(2024, 1, d), 1.0) for d in (2, 3, 5, 8, 9, 15)], "date date, rate double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = align_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), cal, F.col("t"))
    q = stream.writeStream.format("memory").queryName("aligned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.id, r.effective_date) for r in align_strict(rows, cal, F.col("t")).collect()}
    assert {(r.id, r.effective_date) for r in spark.table("aligned").collect()} == want
    q = daily_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("k", F.lit("x")), "t", "k").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("counted").collect()) == 300


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, n int")
    b = spark.createDataFrame([(1, 1), (2, 5), (4, 4)], "k int, n int")
    assert features.reconcile(a, b, "k", ["n"]).head().asDict() == {"matched": 2, "left_only": 1, "right_only": 1, "differ_n": 1}


def test_article_metadata_query_equals_its_sql_on_character_references(spark, tmp_path):
    import duckdb

    import __spark_entry__

    titles = ["one &amp; two", "cut &amp", "say &quot;so&quot;", "cut &", "cut &a", "&amp;amp; &lt;b&gt; &#38; &nbsp;x", "  plain  words\n here"]
    rows = [(i, f"https://x.org/{i}a/b.html", f'<html lang="en"><head><title>{t}</title></head><body><p>t &amp; u</p></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["article_metadata"](spark, str(tmp_path)).collect()}
    sql = __spark_entry__.oracle_sql()["article_metadata"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall()) and len(got) == len(rows)
