"""All ten operators on tables whose columns have names that the operators use, and whose rows repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, jaccard, language, multi_index, passages, quality, secrets, toxicity, warc
from tideline.llm.common import unused

#: Names of columns inside the operators.
EXTRA = (
    "__text __quality ___quality __decon_contaminated __decon_n_words ___decon_x __gone __twice __id __fp __listed __s __e __h __d __m __ids __html __j __c0 k0 k1 "
    "score n fp label rep component_id tokens id n_words ids base runs spans kept secret_text secret_spans host post declared suffix domain payload digest key first "
    "v d rank query_id candidates token tile seen kind start end begin node a b c0 c1"
).split()


def wide(df):
    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(EXTRA) if n not in df.columns))


def rows_of(df, *names):
    picked = df.select(*names) if names else df
    return sorted(picked.collect(), key=lambda r: [str(x) for x in r])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    long = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(12)]
    long[3] = long[2]
    long[5] = long[5] + " " + passage
    long[6] = passage + " " + long[6]
    rows = [(i, t) for i, t in enumerate(long)] + [(20, "password=hunter2x " + "a1" * 20), (21, ""), (22, None), (None, long[2]), (4, long[4]), (4, long[4]), (23, "BUY $$$ " * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_unused():
    assert unused("__q") == "__q" and unused("__q", "__Q", "a") == "___q" and unused("__q", "__quality", "___q") == "____q"


def test_filters_keep_the_columns(spark, docs):
    rng = random.Random(9)
    bench = spark.createDataFrame([("i", docs.where("doc_id = 7").head().text), ("j", " ".join(str(rng.random()) for _ in range(20)))], "item_id string, text string")
    model = quality.CompressionModel([f"w{i} w{i * 3 % 400} w{i * 7 % 400}".encode() * 9 for i in range(80)], [b"BUY $$$ NOW %d " % i * 9 for i in range(80)])
    filters = {
        "quality": lambda d, b: quality.keep_good(d, model),
        "copies": lambda d, b: jaccard.drop_copies(d),
        "benchmark": lambda d, b: decontaminate.decontaminate(d, b),
        "secrets": lambda d, b: secrets.redact(d),
    }
    table = wide(docs)
    whole = rows_of(docs)
    for name, run in filters.items():
        got = run(table, wide(bench))
        assert got.columns == table.columns, name
        found = rows_of(got)
        assert all(tuple(r)[2:] == tuple(f"x{i}" for i in range(len(EXTRA))) for r in found), name
        plain = rows_of(run(docs, bench))
        assert sorted(map(str, (tuple(r)[:2] for r in found))) == sorted(map(str, map(tuple, plain))), name
        assert plain != whole or name == "quality", name


def test_scores_and_classes(spark, docs):
    pu = toxicity.PuModel([], [], 0.1)
    definition = bpe.vocabulary()
    found = {
        "toxicity": lambda d: toxicity.score(d, pu, keep=("doc_id",)),
        "copies": lambda d: jaccard.near_copies(d),
        "tokens": lambda d: bpe.encode_texts(d, definition, keep=("doc_id",)),
        "passages": lambda d: passages.repeated_passages(d),
        "matches": lambda d: decontaminate.longest_matches(d, d.where("doc_id = 7").select(F.lit("i").alias("item_id"), "text", *[c for c in d.columns if c not in ("doc_id", "text")])),
    }
    for name, run in found.items():
        assert rows_of(run(wide(docs))) == rows_of(run(docs)), name
    assert len(rows_of(found["tokens"](docs))) == docs.count() == len(rows_of(found["toxicity"](docs)))


def test_pages(spark):
    html = '<html lang="en">' + "the river and the stone " * 20
    pages = spark.createDataFrame([(1, "http://a.de/x", html), (1, "http://a.de/x", html), (2, "http://a.de/y", html), (3, None, None), (None, "u", "")], "page_id long, url string, html string")
    model = language.TextModel({"en": [b"the river and the stone"] * 3, "de": [b"der fluss und der stein"] * 3})
    assert rows_of(language.identify(wide(pages), model)) == rows_of(language.identify(pages, model)) and language.identify(pages, model).count() == 5
    read = lambda df: rows_of(warc.read(warc.write(df)), "source_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
    assert read(wide(pages)) == read(pages)
    assert [(r.source_id, r.record_type) for r in read(pages)] == [("1", "response"), ("1", "response"), ("2", "revisit"), ("3", "response"), (None, "response")]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    vectors[1] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (90, None), (None, vectors[3].tolist()), (91, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 10 == 0
    plain = multi_index.nearest(frame, frame.where(asked))
    table = wide(frame)
    assert rows_of(multi_index.nearest(table, table.where(asked)), "query_id", "rank", "vec_id") == rows_of(plain, "query_id", "rank", "vec_id")
    assert plain.where("query_id = 0 and rank = 1").head().vec_id == 1


def test_risk_has_its_gradient():
    rng = np.random.default_rng(4)
    xp, xu = (rng.integers(0, 2, (n, 6)).astype(np.float64) for n in (30, 80))
    for prior in (0.05, 0.4):
        theta = rng.normal(size=7)
        value = toxicity.risk(theta, xp, xu, prior)
        loss = lambda g, y: np.log1p(np.exp(-y * g)).mean()
        gp, gu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
        assert value[0] == pytest.approx(prior * loss(gp, 1)) and value[1] == pytest.approx(loss(gu, -1) - prior * loss(gp, -1))
        for part in (0, 1):
            for j in range(7):
                step = np.zeros(7)
                step[j] = 1e-6
                slope = (toxicity.risk(theta + step, xp, xu, prior)[part] - toxicity.risk(theta - step, xp, xu, prior)[part]) / 2e-6
                assert value[2 + part][j] == pytest.approx(slope, abs=1e-7)
