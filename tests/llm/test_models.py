import random

import numpy as np
import pytest

from tideline.llm import language, multi_index, quality, toxicity, warc
from tideline.llm.common import held_out


def good(rng):
    return " ".join(rng.choice(["river", "stone", "letter", "window", "garden", "morning", "paper", "voice"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 90))) + "."


def bad(rng):
    return " | ".join(rng.choice(["BUY", "CLICK", "$$$", "###", "WIN"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 90)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, good(rng) if i % 3 else bad(rng), int(bool(i % 3))) for i in range(300)]
    rows = [(i, t + (" you moron" if i % 7 == 0 else ""), q, int(i % 7 == 0)) for i, t, q in rows]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t, _, _ in rows] + [(None, None, None), (1000, "", 0.0), (1001, "word " * 60_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(corpus):
    docs, labels = corpus
    model = quality.fit(docs, quality.training_labels(labels))
    got = quality.score(docs, model, keep=("doc_id",), name="s").collect()
    assert len(got) == 303 and all(0 <= r.s <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = {r.doc_id for r in docs.where(held_out("doc_id", 5, 0)).collect()}
    hits = [(r.s >= 0.3) == bool(truth[r.doc_id]) for r in got if r.doc_id in held and r.doc_id in truth]
    assert np.mean(hits) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 150 < kept.count() < 260


def test_quality_without_labels(corpus):
    docs, labels = corpus
    assert {r.score for r in quality.score(docs.drop("score"), quality.fit(docs, labels.limit(0))).select("score").collect()} == {0.5}
    assert {r.score for r in quality.score(docs.drop("score"), quality.fit(docs, labels.where("quality = 1"))).select("score").collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.fit(docs, labels), keep=("doc_id",)).count() == 0


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, keep=("doc_id",), name="s").collect()}
    held = {r.doc_id for r in docs.where(held_out("doc_id", 3, 1)).collect() if r.doc_id is not None and r.doc_id < 300}
    assert np.mean([(got[i] >= 0.7) == (i % 7 == 0) for i in held]) > 0.97
    assert got[1000] < 0.3 and got[None] < 0.3 and got[1001] < 0.3
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {round(r.score, 3) for r in toxicity.score(docs.drop("score"), empty).collect()} == {0.05}


def test_negative_risk_is_corrected():
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(100, 5000, 20), [7])).astype(np.uint64) for _ in range(200)]
    unl = [np.unique(np.append(rng.integers(100, 5000, 20), [7] if k % 5 == 0 else [])).astype(np.uint64) for k in range(1000)]
    model = toxicity.PuModel(pos, unl, 0.2)
    assert 7 in model.hashes and model.hashes[np.argmax(model.weights)] == 7 and model.weights.max() + model.bias > 0 > model.bias


def test_language(spark):
    rng = random.Random(1)
    words = {"en": ["the", "river", "with", "stone"], "de": ["der", "fluss", "über", "stein"], "fr": ["le", "fleuve", "près", "pierre"]}
    text = lambda k, n=40: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(["en", "de", "fr"] * 30)] + [(None, None, None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    pages = [(i, f"https://h{k}.example.org/{k}/{i}", f'<html lang="{k}"><script>der der der</script><p>{text(k)}</p></html>') for i, k in enumerate(["en", "de", "fr"] * 20)]
    pages += [(100, "https://hde.example.org/de/x", '<html lang="de"><p></p></html>'), (101, None, None), (None, "", ""), (102, "https://hde.example.org/de/y", f"<p>{text('fr')}</p>")]
    got = {r.id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert len(got) == len(pages) and all(got[i].lang == k for i, k in enumerate(["en", "de", "fr"] * 20))
    assert got[100].lang == "de" and got[102].lang == "fr" and got[101].lang in words and 0 < got[101].score < 0.9
    none = language.identify(spark.createDataFrame(pages[:2], "page_id long, url string, html string"), language.fit(docs.limit(0))).collect()
    assert [r.lang for r in none] == [None, None]
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def brute(rows, asked, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    return {q: [i for _, i in sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q)[:k]] for q in asked if q in unit}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)] + [(2000, [0.0] * 16), (2001, None), (2002, [float("nan")] * 16), (None, rows[0][1]), (2003, [None] * 16), (2004, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in multi_index.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    few = multi_index.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"))
    assert [r.vec_id for r in few.orderBy("rank").collect()] == brute(rows[:3], [0], 5)[0]
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_isotropic_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2000)]
    got = {}
    for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[::50], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert 5 <= r.candidates <= 2000
    want = brute(rows, [i for i, _ in rows[::50]], 5)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_nearest_of_tight_clusters_reads_few_rows(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(100, 64))
    df = spark.createDataFrame([(i, (centres[i % 100] + 0.02 * rng.normal(size=64)).tolist()) for i in range(2000)], "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert all(r.vec_id % 100 == r.query_id % 100 for r in got) and len(got) == 100
    assert max(r.candidates for r in got) < 400


def test_nearest_at_the_ends_of_the_range(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1.1e-200]), (2, [-1e300, 1.0]), (3, [2.0, 2.0]), (4, [1.0, 0.0]), (5, [1.0]), (6, [-3.0]), (0, [9e200, 9e200]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in multi_index.nearest(df, df.where("vec_id in (0, 5)")).orderBy("query_id", "rank").collect()]
    # the least of the vectors of a repeated id asks, and vectors of other lengths are no candidates
    assert got == [(0, 3, 1.0), (0, 1, round(2.1 / (2 * (1 + 1.21)) ** 0.5, 9)), (0, 4, round(0.5**0.5, 9)), (0, 2, round(-(0.5**0.5), 9)), (5, 6, -1.0)]


def test_pigeonhole_probing_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    asked = codes[:20].copy()
    asked[:, 0] ^= np.uint64(0b1011 << 13)
    shard = multi_index.Shard(np.arange(400), rng.normal(size=(400, 4)), codes)
    for radius in (0, 3, 17, 50, 60, 128):
        probes = [multi_index.masks(x) for x in multi_index.shares(radius)]
        for code in asked:
            rows, given = shard.within(code, radius, probes)
            assert rows.tolist() == np.flatnonzero(np.bitwise_count(code ^ codes).sum(1) <= radius).tolist() and len(rows) <= given <= 400


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    long = "<html>" + "é" * 300
    rows = [(5, "http://a.org/x y\r\nz", long), (3, None, long), (9, "http://b.org", "short"), (8, "u", "short"), (7, "u", None), (6, "u", ""), (10, "u", "big " * 50_000), (None, "u", long), (4, "u", long + "!")]
    pages = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, payload string")
    index = warc.write(pages, bundle_bytes=2000)
    got = {r.source_id: r for r in warc.read(index).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, raw = got[str(page) if page is not None else None], (html or "").encode()
        assert r.payload_bytes == len(raw)
        if html == long and page != 3:
            assert r.record_type == "revisit" and r.refers_to == "3" and r.payload is None
        else:
            assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to is None
    for entry in index.collect():
        fields, block = warc.fetch(entry)
        assert fields["warc-record-id"] == entry.record_id and len(block) == int(fields["content-length"])
    assert index.count() == len(rows)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    path = tmp_path / "b.zst"
    w = warc.BundleWriter(open(path, "wb"))
    for k in range(5):
        w.add(b"x" * 200_000 + bytes([k]))
    w.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    with open(path, "rb") as f:
        reader = warc.BundleReader(f)
        assert len(reader.frames) > 1 and b"".join(reader.frame(k) for k in range(len(reader.frames))) == whole
    path.write_bytes(path.read_bytes()[:-1])
    with open(path, "rb") as f, pytest.raises(ValueError):
        warc.BundleReader(f)


def test_visible_equals_one_expression_and_is_linear():
    import re
    import time

    old = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(1)
    parts = [b"<script>", b"</script >", b"<STYLE a>", b"</style>", b"<!--", b"-->", b"<p>", b"<", b">", b"text ", b"<scripty>", b"a<b", b"--", b"<!-->"]
    for _ in range(5000):
        html = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert language.visible(html) == old.sub(b" ", html)

    def seconds(n):
        began = time.perf_counter()
        language.visible(b"<script>x <!-- <style " * n)
        return time.perf_counter() - began

    assert seconds(200_000) <= 2.5 * seconds(100_000) + 0.2


def test_language_posteriors_equal_a_loop(spark):
    import math

    texts = {"en": [b"the house and the river with the old stone"] * 3, "de": [b"das haus und der fluss mit dem alten stein"] * 3}
    model = language.TextModel(texts)
    pages = [(1, "http://a.de/x", '<html lang="de">das haus und'), (2, "http://a.de/y", "<html lang=en>the house"), (3, "http://www.a.de/", "der"), (4, None, None), (5, "http://b.com/en/", "the river und"), (5, "http://b.com/en/", "the river und")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    rows = language.evidence(df, model).collect()
    softmax = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
    post = [softmax(r.text) for r in rows]
    share = [sum(p[k] for p in post) + 1 for k in range(2)]
    share = [s / sum(share) for s in share]
    want = []
    for i, r in enumerate(rows):
        logs = []
        others = {c: [sum(post[j][k] for j, o in enumerate(rows) if o[c] == r[c] and j != i) for k in range(2)] for c in ("host", "domain", "declared", "suffix")}
        for k in range(2):
            domain = (others["domain"][k] + language.DOMAIN_PULL * share[k]) / (sum(others["domain"]) + language.DOMAIN_PULL)
            log = r.text[k] + math.log((others["host"][k] + language.HOST_PULL * domain) / (sum(others["host"]) + language.HOST_PULL))
            for c in ("declared", "suffix"):
                if r[c]:
                    log += math.log((others[c][k] + language.EVIDENCE_PULL * share[k]) / ((sum(others[c]) + language.EVIDENCE_PULL) * share[k]))
            logs.append(log)
        want.append((r.id, model.languages[logs.index(max(logs))], round(max(softmax(logs)), 9)))
    assert sorted((r.id, r.lang, round(r.score, 9)) for r in language.identify(df, model).collect()) == sorted(want)


def test_quality_sizes_equal_plain_compression():
    import zstandard

    rng = random.Random(5)
    model = quality.CompressionModel([good(rng).encode() for _ in range(60)], [bad(rng).encode() for _ in range(60)])
    for text in (b"", b"river stone", (good(rng) * 100).encode()):
        want = [len(text)]
        for raw in model.dictionaries:
            blocks = [text[i : i + quality.BLOCK] for i in range(0, max(1, len(text)), quality.BLOCK)]
            want.append(sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in blocks))
        assert model.sizes([text])[0].tolist() == want
