import random
import re

import numpy as np

from tideline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    wins = {}
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(name)
    out = []
    for t in docs:
        w, hit, got = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                names = wins.get(tuple(w[i : i + k]))
                if names:
                    hit.update(range(i, i + k))
                    got |= names
        out.append((len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "Bee", "cé", "d1", "x"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [("1", line(20)), ("2", line(5)), ("10", line(13)), ("3", ""), ("4", None), ("5", "zz")]
    docs = [line(rng.randint(0, 60)) for _ in range(20)] + [None, "", "zz", "!!", items[0][1] + " tail, " + items[1][1], items[2][1].upper(), "q " * 3000 + items[0][1]]
    return docs, items


def test_equals_brute_force(spark):
    for seed in range(4):
        docs, items = make(seed)
        rows = spark.createDataFrame(list(enumerate(docs)), "n_words long, text string")
        bench = spark.createDataFrame([(int(a), b) for a, b in items], "item_id long, text string")
        for size in (d.BLOCK_BYTES, 60):
            got = {r.n_words: r for r in d.hits(rows, bench, keep=("n_words",), prefix="p_", block_bytes=size).collect()}
            for k, want in enumerate(brute(docs, items)):
                r = got[k]
                assert (r.p_n_words, r.p_n_hit, r.p_items, r.p_contaminated) == want


def test_decontaminate_keeps_columns_and_rows(spark):
    docs, items = make(1)
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)] + [(None, None, None)] * 2, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    kept = d.decontaminate(rows, bench)
    assert kept.columns == rows.columns
    want = [k for k, w in enumerate(brute(docs, items)) if not w[3]]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 2
    assert d.decontaminate(rows, bench.limit(0)).count() == rows.count()
    assert d.decontaminate(rows.limit(0), bench).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        order = d.suffix_array(s)
        tails = [tuple(s[i:]) for i in order]
        assert tails == sorted(tails) and sorted(order.tolist()) == list(range(n))


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(7, "pre " + " ".join(f"w{i}" for i in range(3, 25)) + " post"), (8, "none")], "doc_id long, text string")
    got = {r.item_word: r for r in d.longest_matches(rows, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert got[3].n_words == 22 and got[3].doc == "7" and got[3].doc_word == 1 and min(got) == 3 and max(got) == 12
