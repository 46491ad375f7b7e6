import random
import re


from tideline.llm import jaccard, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    label = {n: i for n, (i, _) in enumerate(sets)}
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for n in range(len(sets)):
        r = find(n)
        if label[n] is not None:
            least[r] = min(least.get(r, label[n]), label[n])
    return {(label[n], len(sets[n][1]), least.get(find(n))) for n in range(len(sets))}


def corpus(seed, groups=12, copies=9, size=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randint(0, 30))
    docs, k = [], 0
    common = [word() for _ in range(20)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, size))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            docs.append((k, " ".join(w) if rng.random() < 0.9 else "  ".join(w).upper()))
            k += 1
    return docs + [(k, None), (k + 1, ""), (k + 2, "one"), (k + 3, "ONE"), (k + 4, " \n ")]


def test_equals_brute_force(spark):
    for seed in range(2):
        docs = corpus(seed)
        random.Random(seed).shuffle(docs)
        got = jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=4, percent=85).collect()
        assert {tuple(r) for r in got} == brute(docs, 4, 85) and len(got) == len(docs)


def test_large_groups_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", 3)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 6_000)
    docs = corpus(5, groups=3, copies=60, size=50)
    got = jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=70).collect()
    assert {tuple(r) for r in got} == brute(docs, 3, 70)


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    new = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    kept = ruled_out = 0
    for n in (1, 5, 60, 64, 65, 700, 5000, 140_000):
        for share in (0.0, 0.05, 0.08, 0.1, 0.3, 1.0):
            x = new(n)
            y = np.union1d(x[: n - int(share * n * rng.random())], new(int(share * n)))
            inter = len(np.intersect1d(x, y))
            one, two = (jaccard._Sketch(jaccard.sketch(s), len(s)) for s in (x, y))
            linked = 100 * inter >= 85 * (len(x) + len(y) - inter)
            kept += linked
            assert one.may_link(two, 85) or not linked
        ruled_out += not jaccard._Sketch(jaccard.sketch(x), n).may_link(jaccard._Sketch(jaccard.sketch(new(n)), n), 85)
    assert kept > 15 and ruled_out >= 7


def test_chance_matches_make_no_groups(spark, monkeypatch):
    rng = random.Random(6)
    common = "one two three four"
    first = int(jaccard.Shingles(4).sets(jaccard.pa.array([common])).__next__()[0])
    docs, few = [], []
    while len(docs) < 60:  # the shared shingle is in all prefixes
        text = common + "".join(f" v{rng.randint(0, 10**6)}" for _ in range(3))
        if int(next(jaccard.Shingles(4).sets(jaccard.pa.array([text])))[0]) == first:
            docs.append((len(docs), text))
    docs += [(60, docs[7][1].upper()), (61, " ".join(f"w{i}" for i in range(90))), (62, " ".join(f"w{i}" for i in range(91)))]
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    sets_of = jaccard._sets_of
    monkeypatch.setattr(jaccard, "_sets_of", lambda rows, ids, *a: few.append(ids.count()) or sets_of(rows, ids, *a))
    for most in (100, 24, 5):  # as pairs, by sketches, as stars
        monkeypatch.setattr(jaccard, "PAIRS_UP_TO", min(most, 24) if most < 100 else 100)
        monkeypatch.setattr(jaccard, "SKETCHED_UP_TO", 2048 if most > 5 else 5)
        got = jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=4, percent=85).collect()
        assert {tuple(r) for r in got} == brute(docs, 4, 85)
    assert few[:2] == [2, 2] and few[2] > 2


def test_prefixes_are_shuffled_class_by_class(spark, monkeypatch):
    rng = random.Random(9)
    docs = corpus(7) + [(1000 + k, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(40))) for k in range(60)]
    written, rows = jaccard.written, {}

    def counted(df, name):
        out = written(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "STEP_ROWS", 300, raising=False)
    got = jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=4, percent=85).collect()
    assert {tuple(r) for r in got} == brute(docs, 4, 85) and len(got) == len(docs)
    assert len(rows["several"]) == min(8, 1 + rows["prefixes"][0] // 300) > 2
    for name in ("several", "raw", "shared"):
        assert 0 < max(rows[name]) < 0.7 * sum(rows[name])


def test_drop_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, text + " more", "c"), (1, None, "d"), (2, "", "e"), (None, "zzz", "f"), (4, "unlike", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = jaccard.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4]
    assert jaccard.near_copies(docs.limit(0)).count() == 0


def test_drop_copies_without_or_with_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, text("a")), (None, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("c") + " more"), (8, text("d")), (8, text("a")), (None, ""), (None, None), (9, text("e"))]
    kept = jaccard.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept) == [(0, ""), (0, ""), (0, "b"), (5, "a"), (7, "c"), (8, "d"), (9, "e")]


def passage_docs():
    rng = random.Random(3)
    word = lambda: "v" + str(rng.randint(0, 100_000))
    text = lambda n: [word() for _ in range(n)]
    shared, line, short = text(70), text(12), text(40)
    docs = {1: text(80) + shared + text(30), 2: shared + text(200), 3: text(150), 4: text(60) + line + text(60), 5: text(70) + line + text(50)}
    docs |= {6: text(30) + short + text(90), 7: text(90) + short + text(20), 8: text(40)}
    edited = list(shared)
    edited[35] = word()
    docs[9] = text(100) + edited + text(10)
    other = text(64)
    docs |= {10 + k: text(30 + k) + line + short + other + text(9) for k in range(3)}
    return docs


def test_repeated_passages(spark):
    docs = passage_docs()
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(None, None), (20, ""), (21, " ".join(docs[3]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 9, 10, 11, 12, 3, 21}
    spans = {(r.doc_id, r.start_word, r.end_word) for r in got}
    assert (1, 80, 150) in spans and (2, 0, 70) in spans
    assert any(d == 9 and s <= 105 and e >= 165 for d, s, e in spans)
    for r in got:
        a, b = docs[3 if r.doc_id == 21 else r.doc_id][r.start_word : r.end_word], docs[3 if r.other_doc_id == 21 else r.other_doc_id][r.other_start : r.other_end]
        x, y = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}, {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        assert len(a) >= 50 and len(b) >= 50 and len(x & y) >= 0.8 * len(x | y)


def test_edited_passages_beside_a_third_document(spark):
    rng = random.Random(8)
    text = lambda n: ["v" + str(rng.randint(0, 10_000_000)) for _ in range(n)]
    docs, line = [], text(30)
    for k in range(60):
        one = text(60) if k % 3 else line + text(30)
        two = list(one)
        two[30 + k % 20 : 31 + k % 20] = text(1 + (k % 3 == 2))  # a word is another one, or two
        docs += [text(100) + one + text(40), text(70) + two + text(60), text(50) + one[: 30 + 10 * (k % 3 > 0)] + text(50)]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    spans = {i: [(r.start_word, r.end_word) for r in got if r.doc_id == i] for i in range(len(docs))}
    for i in range(0, len(docs), 3):
        assert any(s <= 105 and e >= 155 for s, e in spans[i]) and any(s <= 75 and e >= 125 for s, e in spans[i + 1]) and not spans[i + 2]


def test_passage_goes_on_past_runs_on_other_diagonals():
    import numpy as np

    x = np.arange(61, dtype=np.uint32)
    y = x.copy()
    y[30] = 1000
    parts, known = [y], [0]
    for k, s in enumerate(range(18, 6, -2)):  # backwards, so that they make no chain
        known.append(s - sum(map(len, parts)) - 1)
        parts.append(np.concatenate([[2000 + k], x[s : s + 9]]).astype(np.uint32))
    got = passages.shared_passages(x, np.concatenate(parts), [], known)
    assert [g[:4] for g in got] == [(0, 61, 0, 61)]


def test_no_passages(spark):
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "ab " * 500), (2, "cd " * 500)], "doc_id long, text string")
    assert passages.repeated_passages(same).count() == 0


def test_compact_windows_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (5, 40, 3000):
        h = rng.integers(0, 1 << 60, n).astype(np.uint64)
        left, c, right = passages.compact_windows(h, np.array([0]), np.array([n]), 6)
        got = set(zip(left.tolist(), c.tolist(), right.tolist(), strict=True))
        want = set()
        for i in range(n):
            a = b = i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while b < n - 1 and h[b + 1] >= h[i]:
                b += 1
            if b - a + 1 >= 6:
                want.add((a, i, b))
        assert got == want


def test_components(spark):
    from tideline.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_of_unlinked_sets_are_nearly_linear():
    import time

    import numpy as np

    def seconds(n):
        rng = np.random.default_rng(n)
        sets = [np.unique(rng.integers(0, 10 * n, 5).astype(np.uint64)) for _ in range(n)]
        began = time.perf_counter()
        links = jaccard.spanning_links(sets, np.ones(n, bool), 80)
        assert len(links) < n // 10
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) <= 2.5 * seconds(8000) + 0.5


def test_agreeing_matches_are_found_in_linear_time():
    import time

    import numpy as np

    def seconds(n):
        words = np.arange(n, dtype=np.uint32)
        matches = [(c, 40 << 31 | 40, c, 40 << 31 | 40, c % 3) for c in range(0, n - 5, 8)]
        began = time.perf_counter()
        assert passages.shared_passages(words, words, matches)[0][:4] == (0, n, 0, n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) <= 2.5 * seconds(40_000) + 0.3


def test_windows_beyond_65535_words(spark):
    rng = random.Random(2)
    text = lambda n: ["v" + str(rng.randint(0, 10_000_000)) for _ in range(n)]
    shared = text(70_000)
    docs = [text(30) + shared, shared + text(50), text(100) + shared[65_600:65_700]]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.start_word, r.end_word) for r in got}
    assert {(0, 30, 70_030), (1, 0, 70_000)} & spans and (2, 100, 200) in spans
