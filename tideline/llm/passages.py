"""Near-duplicate passages by compact windows.

A document is the sequence of its five-word shingles. Under each of a few hash functions, the Cartesian tree over the
hashes groups all subsequences of a minimum length that have the same minimum: a compact window (l, c, r) stands for all
that begin in [l, c] and end in [c, r]. Windows meet by the shingle at their minimum; of all documents that share one,
the one with the smallest fingerprint is the centre of a star, so that rows stay linear. Where enough hash functions
agree for a pair, with intervals that overlap on both sides, the words decide: exact runs around the minima are chained
over small edits, and a passage stands if it is long and similar enough.

A star loses passages that its centre lacks. So spans around the shared minima meet, too, by the words at their two ends,
whatever an edit has made of those between: all spans of the minimum length, and spans between anchors (least hashes of
short runs) of any length about that, for words that came or went. What a passage with a centre explains exactly, the
centre stands for. The words decide again; what a span's centre leaves open meets the next centre, and then those that
agree with it in a hash of what is between the ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, bucketed, discard, listed, mix, shingle_hashes, table, text_chunks, utf8, word_hashes, word_spans, written
from .jaccard import fingerprint

SHINGLE = 5
#: Words of the shortest passage, hash functions, and how many must agree.
LEAST_WORDS, HASHES, ENOUGH = 50, 3, 2
SIMILARITY = 0.8
#: Words that an edit inside a passage may span, and words of the shortest exact run that counts.
GAP, RUN = 10, 8
#: Runs of RUN words among which the one of least hash is an anchor, and words of the shortest and the longest span between
#: two anchors. 15 words have an anchor; so of LEAST_WORDS words with one edit of up to GAP words inside, there are two
#: anchors as far apart, in the longer part (38 words hold two 24 to 31 words apart) or on either side of the edit.
ANCHORS, LEAST_SPAN, MOST_SPAN = 8, 24, 44
#: Words of the exact runs that begin or end at a minimum by which spans are searched: of LEAST_SPAN exact words, all but
#: one, any minimum has one of the two.
GRAM = 14
#: Bytes of word hashes in a bucket of sequences, about.
BUCKET_BYTES = 32_000_000
_LEVELS = 10
_FLUSH = 500_000
_HALF = (1 << 31) - 1


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return word_hashes(data, starts, ends, LOWER), first


def compact_windows(h: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the Cartesian trees over the sequences [begin, end) of ``h`` that span ``least`` places
    or more; of equal values the first is the minimum of those that it begins."""
    long = end - begin >= least
    begin, end = begin[long], end[long]
    none = (np.zeros(0, np.int64),) * 3
    if not len(begin):
        return none
    levels = [h]  # levels[k][i]: minimum of 2^k values from i on
    for k in range(_LEVELS):
        a = levels[-1]
        if len(a) <= 1 << k:
            break
        levels.append(np.minimum(a[: len(a) - (1 << k)], a[1 << k :]))
    k = least.bit_length() - 1
    m = len(h) - least + 1
    low = np.minimum(levels[k][:m], levels[k][least - (1 << k) : least - (1 << k) + m])  # of each subsequence of that length
    inside = np.zeros(m + 1, np.int8)
    inside[begin] += 1
    inside[end - least + 1] -= 1
    fresh = np.cumsum(inside, dtype=np.int8)[:m].astype(bool)
    fresh[1:] &= low[1:] != low[:-1]
    fresh[begin] = True
    start = np.flatnonzero(fresh)
    owner = np.searchsorted(begin, start, side="right") - 1
    c = np.concatenate([start[a : a + 20_000] + np.argmin(h[start[a : a + 20_000, None] + np.arange(least)], axis=1) for a in range(0, len(start), 20_000)])
    c, pick = np.unique(c, return_index=True)
    first, last, value = begin[owner[pick]], end[owner[pick]], h[c]
    left, right = c.copy(), c + 1
    for k in range(len(levels) - 1, -1, -1):
        step, table_ = 1 << k, levels[k]
        again = True
        while again:  # more than one step only at the top level
            to = left - step
            go = to >= first
            go[go] = table_[to[go]] > value[go]
            left = np.where(go, to, left)
            to = right + step
            ahead = to <= last
            ahead[ahead] = table_[right[ahead]] >= value[ahead]
            right = np.where(ahead, to, right)
            again = k == len(levels) - 1 and bool(go.any() or ahead.any())
    return left, c, right - 1


def windows(docs: DataFrame, text_col: str, doc_col: str) -> DataFrame:
    """Rows of two kinds: (doc_id, fp, n) of each document, and (key, fp, c, reach, which) of each compact window of each
    distinct word sequence (a task emits a sequence once). ``reach`` packs c - l and r - c."""
    picked = docs.select(docs[doc_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    kind = dict(picked.dtypes)["doc_id"]
    names = ["doc_id", "fp", "n", "key", "c", "reach", "which"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for chunk in text_chunks(batches, limit=3_000_000):
            words, first = _words(chunk.column(1))
            m, n = chunk.num_rows, np.diff(first)
            fps = [None if a == b else sequence_fingerprint(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            null = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(fps, pa.int64()), pa.array(n, pa.int64()), null(pa.int64(), m), null(pa.int32(), m), null(pa.int64(), m), null(pa.int32(), m)], names=names)
            new = np.zeros(m, bool)
            for k, fp in enumerate(fps):
                if fp is not None and n[k] >= LEAST_WORDS and fp not in done:
                    new[k] = True
                    done.add(fp)
            if len(done) > 200_000:
                done.clear()
            if not new.any():
                continue
            shingles = mix(_grams(words, SHINGLE))
            begin, end = first[:-1][new], first[1:][new] - SHINGLE + 1
            fp = np.array([x for x, k in zip(fps, new, strict=True) if k], np.int64)
            for f in range(HASHES):
                h = mix(shingles ^ mix(np.array([f + 1], np.uint64)))
                left, c, right = compact_windows(h, begin, end, LEAST_WORDS - SHINGLE + 1)
                own = np.searchsorted(begin, c, side="right") - 1
                reach = ((c - left) << 31) | (right - c)
                k = len(c)
                yield pa.RecordBatch.from_arrays([null(chunk.column(0).type, k), pa.array(fp[own]), null(pa.int64(), k), pa.array(h[c].view(np.int64)), pa.array((c - begin[own]).astype(np.int32)), pa.array(reach), pa.array(np.full(k, f, np.int32))], names=names)

    return picked.mapInArrow(run, f"doc_id {kind}, fp long, n long, key long, c int, reach long, which int")


def sequence_fingerprint(words: np.ndarray) -> int:
    """A 64-bit fingerprint of a sequence of words, signed."""
    with np.errstate(over="ignore"):
        return fingerprint(words + mix(np.arange(1, len(words) + 1, dtype=np.uint64)))


def _runs_on(x: np.ndarray, y: np.ndarray, d: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs (begin in x, end, begin in y) of RUN words or more where x[i] stands against y[i - d]."""
    a, b = max(0, d), min(len(x), len(y) + d)
    if b - a < RUN:
        return []
    same = np.zeros(b - a + 2, np.int8)
    same[1:-1] = x[a:b] == y[a - d : b - d]
    step = np.diff(same)
    return [(a + s, a + e, a + s - d) for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True) if e - s >= RUN]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Numbers of 64 bits for the runs of ``k`` words, given the words' hashes: cheap, to tell the runs of a pair apart."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    return out


def _similarity(a: list[int], b: list[int]) -> float:
    """Jaccard similarity of two lists of shingles."""
    a, b = set(a), set(b)
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def _agreeing(matches: list[tuple[int, int, int, int, int]]) -> set[int]:
    """Diagonals of the matches that ENOUGH hash functions share: an interval join over cells. A window stands in for the
    subsequences of about the minimum length at its minimum, so that two matches agree if their diagonals and their
    minima are near each other and each minimum lies in the other window; cells of that size are looked up, linear in
    the matches but for many in one cell."""
    wide, drift = LEAST_WORDS, GAP + RUN
    cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for c, r, k, s, f in matches:
        cells.setdefault(((c - k) // drift, c // wide), []).append((f, max(c - (r >> 31), k - (s >> 31) + c - k), min(c + (r & _HALF), k + (s & _HALF) + c - k)))
    out = set()
    for c, _, k, _, f in matches:
        i, j = (c - k) // drift, c // wide
        which = {f}
        for cell in ((i + a, j + b) for a in (0, -1, 1) for b in (0, -1, 1)):
            which.update(g for g, low, high in cells.get(cell, ()) if low - drift <= c <= high + drift)
            if len(which) >= ENOUGH:
                out.add(c - k)
                break
    return out


def _chained(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The runs, sorted, in chains over edits of up to GAP words."""
    chains: list[list[tuple[int, int, int]]] = []
    live: list[list[tuple[int, int, int]]] = []  # those that a run that begins here or later may go on
    for run in runs:
        s, e, t = run
        live = [chain for chain in live if s - chain[-1][1] <= GAP]
        for chain in reversed(live):
            _, e0, t0 = chain[-1]
            f0 = t0 + (e0 - chain[-1][0])
            if -RUN < s - e0 <= GAP and -RUN < t - f0 <= GAP and e > e0:
                chain.append(run)
                break
        else:
            chains.append([run])
            live.append(chains[-1])
    return chains


def _beside(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]]) -> set[int]:
    """Diagonals on which an equal run goes on beyond either end of a chain, after words that came or went; ``x`` and ``y``
    are the runs of RUN words."""
    out = set()
    s, e, t, u = chain[0][0], chain[-1][1], chain[0][2], chain[-1][2] + chain[-1][1] - chain[-1][0]
    for a, b, c, d in ((e, e + GAP + 1, u, u + GAP + 1), (max(0, s - GAP - RUN), max(0, s - RUN + 1), max(0, t - GAP - RUN), max(0, t - RUN + 1))):
        here, there = x[a:b], y[c:d]
        i, j = np.nonzero(here[:, None] == there[None, :])
        if len(i):
            out.update((i + a - j - c).tolist())
    return out


def shared_passages(x: np.ndarray, y: np.ndarray, matches: list[tuple[int, int, int, int, int]], known: Iterable[int] = ()) -> list[tuple[int, int, int, int, float, list[int]]]:
    """Passages (begin, end in x, begin, end in y, similarity, exact runs in x as begin, end, begin, end ...), in words,
    given the matches (c in x, reach, c in y, reach, hash function) of windows with the same minimum, and known
    diagonals."""
    diagonals = set(known) | _agreeing(matches)
    runs = {r for d in diagonals for r in _runs_on(x, y, d)}
    gx, gy = _grams(x, RUN), _grams(y, RUN)
    while True:
        chains = _chained(sorted(runs))
        new = {d for chain in chains if chain[-1][1] - chain[0][0] >= LEAST_SPAN for d in _beside(gx, gy, chain)} - diagonals
        if not new:
            break
        diagonals |= new
        runs |= {r for d in new for r in _runs_on(x, y, d)}
    gx, gy = _grams(x, SHINGLE).tolist(), _grams(y, SHINGLE).tolist()
    out = []
    while chains:  # a chain that isn't similar enough falls apart at its widest edit
        chain = chains.pop()
        s, e, t, u = chain[0][0], chain[-1][1], chain[0][2], chain[-1][2] + chain[-1][1] - chain[-1][0]
        if e - s < LEAST_WORDS or u - t < LEAST_WORDS:
            continue
        sim = 1.0 if len(chain) == 1 else _similarity(gx[s : e - SHINGLE + 1], gy[t : u - SHINGLE + 1])
        if sim >= SIMILARITY:
            out.append((s, e, t, u, sim, [p for r in chain for p in r[:2]]))
        elif len(chain) > 1:
            wide = [max(b[0] - a[1], b[2] - a[2] - (a[1] - a[0])) for a, b in zip(chain, chain[1:], strict=False)]
            cut = wide.index(max(wide)) + 1
            chains += [chain[:cut], chain[cut:]]
    return sorted(out)


def _sequences(docs: DataFrame, ids: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(fp, words) of the documents listed in ``ids`` (rep): 32-bit word hashes, enough beside 64-bit minima."""
    rows = docs.select(docs[doc_col].alias("id"), docs[text_col].cast("string").alias("__text"))
    rows = listed(rows, "id", ids.select("rep")).select("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=2_000_000):
            words, first = _words(chunk.column(0))
            parts = [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([sequence_fingerprint(p) for p in parts], pa.int64()), pa.array([(p >> np.uint64(32)).astype(np.uint32).tobytes() for p in parts], pa.binary())], names=["fp", "words"])

    return rows.mapInArrow(run, "fp long, words binary")


_FOUND = "fp long, s int, e int, lead long, ls int, le int, similarity double, runs array<int>"


def _verified(pairs: DataFrame) -> DataFrame:
    """_FOUND rows of pairs (fp, lead, x, y, matches, diagonals), of which one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fp, lead, x, y, matches, diagonals in zip(*(c for c in batch.columns), strict=True):
                m = [tuple(v.values()) for v in matches.as_py() or ()]
                found = shared_passages(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), m, diagonals.as_py() or ())
                out += [(fp.as_py(), s, e, lead.as_py(), t, u, sim, runs) for s, e, t, u, sim, runs in found]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["fp", "s", "e", "lead", "ls", "le", "similarity", "runs"])

    return pairs.select("fp", "lead", "x", "y", "matches", "diagonals").mapInArrow(run, _FOUND)


def _sides(pairs: DataFrame, seqs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (fp, lead) with the words x and y of both. ``seqs`` is dealt by fp and stays where it is; the few leads' words
    are a table, as a lead can have many pairs: a plain shuffle on either side, which Spark can split."""
    leads = written(pairs.select(F.col("lead").alias("fp")).distinct().join(seqs, "fp"), f"{name}-leads")
    return pairs.join(seqs.withColumnRenamed("words", "x"), "fp").join(leads.select(F.col("fp").alias("lead"), F.col("words").alias("y")), "lead")


class _Least:
    """Least values of ranges: levels of minima over powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        for k in range(longest.bit_length() - 1):
            a = self.levels[-1]
            self.levels.append(np.minimum(a[: max(0, len(a) - (1 << k))], a[1 << k :]))

    def of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][begin[at]], self.levels[k][begin[at] + size[at] - (1 << int(k))])
        return out


def anchors(ends: np.ndarray) -> np.ndarray:
    """Places of the least of each ANCHORS neighbouring values; of equal ones the first."""
    if len(ends) < ANCHORS:
        return np.zeros(0, np.int64)
    near = np.lib.stride_tricks.sliding_window_view(ends, ANCHORS)
    return np.unique(np.argmin(near, axis=1) + np.arange(len(near)))


def _owners(length: int, held: list[tuple[int, int, list[int] | None]], size: int) -> np.ndarray:
    """Of each place the passage in ``held`` that holds the ``size`` words that begin there in one exact run, or -1."""
    owner = np.full(length + 1, -1)
    for k, (_, _, runs) in enumerate(held):
        for a, b in zip((runs or ())[::2], (runs or ())[1::2], strict=True):
            owner[a : max(a, b - size + 1)] = k
    return owner


def _free(held: list[tuple[int, int, list[int] | None]], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether no passage in ``held`` covers the words from ``begin`` to ``end``."""
    begins, stops = np.array(sorted((a, b) for a, b, _ in held) or [], np.int64).reshape(-1, 2).T
    begins, stops = np.append(-1, begins), np.maximum.accumulate(np.append(-1, stops))
    return stops[np.searchsorted(begins, begin, side="right") - 1] < end


def grams_at(w: np.ndarray, minima: np.ndarray, held: list[tuple[int, int, list[int] | None]]) -> tuple[np.ndarray, ...]:
    """(gram, c, open) of the GRAM words from each minimum's shingle on, and of those up to its end; not of those that an
    exact run of a passage in ``held`` has, as its other side has them, too."""
    grams, c = mix(_grams(w, GRAM)), np.unique(minima)
    at = np.concatenate([c, c + SHINGLE - GRAM])
    c = np.append(c, c)
    good = (at >= 0) & (at < len(grams))
    good[good] = _owners(len(w), held, GRAM)[at[good]] < 0
    return grams[at[good]], c[good], _free(held, c[good], c[good] + SHINGLE)


def spans_around(w: np.ndarray, minima: np.ndarray, held: list[tuple[int, int, list[int] | None]]) -> tuple[np.ndarray, ...]:
    """(span, inner, s, t, open) of the spans of the words ``w`` that hold one of the ``minima`` (places of shingles): those
    of LEAST_WORDS words, and those between two anchors of LEAST_SPAN to MOST_SPAN words. ``span`` stands for the
    kind and the RUN words at either end, which begin at s and t; ``inner`` packs four hashes of 16 bits of what is
    between: the least hash of its shingles under HASHES functions, and their sum. Open are the spans that no passage in
    ``held`` (begin, end, exact runs) covers; spans whose ends lie in exact runs of one passage are left out, as its
    other side has them, too."""
    ends, shingles = mix(_grams(w, RUN)), _grams(w, SHINGLE)
    c = np.unique(minima)
    parts = []
    s = np.arange(max(0, len(w) - LEAST_WORDS + 1))
    parts.append((s, s + LEAST_WORDS - RUN, np.full(len(s), 1, np.uint64)))
    at = anchors(ends)
    low, high = np.searchsorted(at, at + LEAST_SPAN - RUN), np.searchsorted(at, at + MOST_SPAN - RUN, side="right")
    size = high - low
    stops = np.cumsum(size)
    pick = np.repeat(low - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
    parts.append((np.repeat(at, size), at[pick], np.full(len(pick), 2, np.uint64)))
    s, t, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    around = np.searchsorted(c, s) < np.searchsorted(c, t + RUN - SHINGLE, side="right")
    owner = _owners(len(w), held, RUN)
    around &= (owner[s] < 0) | (owner[s] != owner[t])
    s, t, kind = s[around], t[around], kind[around]
    free = _free(held, s, t + RUN)
    span = mix(ends[s] ^ mix(ends[t] + kind))
    inner = np.zeros(len(s), np.uint64)
    if len(s):
        within = t + RUN - SHINGLE + 1 - s  # shingles of the span
        for f in range(HASHES):
            least = _Least(mix(shingles ^ mix(np.array([f + 11], np.uint64))), LEAST_WORDS)
            inner |= (least.of(s, within) & np.uint64(0xFFFF)) << np.uint64(16 * f)
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum(mix(shingles), dtype=np.uint64))
            inner |= mix(sums[s + within] - sums[s]) >> np.uint64(48) << np.uint64(48)
    return span, inner, s, t, free


def _around(rows: DataFrame, find, names: str) -> DataFrame:
    """fp and what ``find`` (grams_at or spans_around) finds in the sequences (fp, words, cs, held), columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.bool_() if n == "open" else pa.int32() if len(n) == 1 else pa.int64() for n in names.split()]
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for k, (fp, words, cs, held) in enumerate(zip(*batch.columns, strict=True)):
                w = np.frombuffer(words.as_py(), np.uint32).astype(np.uint64)
                passages = [(p["s"], p["e"], p["runs"]) for p in held.as_py() or ()]
                got = find(w, np.array(cs.as_py(), np.int64), passages)
                out.append((np.full(len(got[0]), fp.as_py(), np.int64), *got))
                if sum(len(x[0]) for x in out) > _FLUSH or k == batch.num_rows - 1:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, [pa.int64(), *types], strict=True)], names=["fp", *names.split()])
                    out = []

    schema = ", ".join(f"{n} {'boolean' if n == 'open' else 'int' if len(n) == 1 else 'long'}" for n in ["fp", *names.split()])
    return rows.select("fp", "words", "cs", "held").mapInArrow(run, schema.replace("fp int", "fp long"))


def _swapped(found: DataFrame) -> DataFrame:
    """_FOUND rows from the other side, without runs."""
    return found.select(F.col("lead").alias("fp"), F.col("ls").alias("s"), F.col("le").alias("e"), F.col("fp").alias("lead"), F.col("s").alias("ls"), F.col("e").alias("le"), "similarity", F.lit(None).cast("array<int>").alias("runs"))


def _uncovered(rows: DataFrame, held: DataFrame, begin: str, end: str) -> DataFrame:
    """The rows whose words from ``begin`` to ``end`` no passage in ``held`` (fp, s, e) covers."""
    covered = held.select(F.col("fp").alias("__fp"), F.col("s").alias("__s"), F.col("e").alias("__e"))
    return rows.join(covered, (F.col("fp") == F.col("__fp")) & (F.col("__s") <= F.expr(begin)) & (F.expr(end) <= F.col("__e")), "left_anti")


def _met(rows: DataFrame, name: str, key: str, headed: bool = False) -> DataFrame:
    """The rows whose key more than one sequence has, one of them open there, written; if so asked, with the first and the
    last row of the key (struct of fp, s, t, open) as head and mate. The keys are a table of their own, so that the join
    has a plain shuffle on either side and Spark can split a key that many sequences share."""
    row = F.struct("fp", "s", "t", "open") if headed else None
    ends = [F.min(row).alias("head"), F.max(row).alias("mate")] if headed else []
    keys = rows.groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.max("open").alias("o"), *ends).where("a <> b and o").drop("a", "b", "o")
    keys = written(keys, f"{name}-keys")
    out = written(rows.join(keys, key), name)
    discard(keys)
    return out


def _round(left: DataFrame, seqs: DataFrame, name: str) -> DataFrame:
    """_FOUND rows of one star for each key: of all with a key the one with the smallest fingerprint is the centre; its first
    place meets all places of the others, its other places that are open a place of the last."""
    others = left.where("fp <> head.fp and (open or head.open)").select("fp", F.col("head.fp").alias("lead"), F.array(F.col("s") - F.col("head.s"), F.col("t") - F.col("head.t")).alias("d"))
    again = left.where("fp = head.fp and s > head.s and open").select(F.col("mate.fp").alias("fp"), F.col("fp").alias("lead"), F.array(F.col("mate.s") - F.col("s"), F.col("mate.t") - F.col("t")).alias("d"))
    pairs = written(others.unionByName(again).groupBy("fp", "lead").agg(F.array_distinct(F.flatten(F.collect_set("d"))).alias("diagonals")), f"{name}-pairs")
    found = written(_verified(_sides(pairs, seqs, name).withColumn("matches", F.lit(None))), name)
    discard(pairs)
    return found


def _settled(spans: DataFrame, seqs: DataFrame) -> DataFrame:
    """_FOUND rows of the sequences that meet by spans, one of them open: against the centre of each span, then, of what is
    left open, against the next centres among those that agree in a part of ``inner``, too, one for each part. Groups
    shrink from key to key, and no step makes more rows than a few times those it has."""
    names = spans.columns
    left = _met(spans, "met", "span", True)
    discard(spans)
    done = _round(left, seqs, "settled0")
    # each centre has met all others with its span
    rest = left.where("fp <> head.fp").select(*names)
    still = _uncovered(rest.where("open"), done.unionByName(_swapped(done)), "s", f"t + {RUN}")
    rest = still.unionByName(rest.withColumn("open", F.lit(False))).groupBy("span", "inner", "fp", "s", "t").agg(F.max("open").alias("open"))
    rest = written(rest.select(*names), "rest")
    discard(left)
    parts = F.explode(F.array(*(F.xxhash64("span", F.lit(i), F.shiftright("inner", 16 * i).bitwiseAND(0xFFFF)) for i in range(HASHES + 1))))
    left = _met(rest.select(*names, parts.alias("key")), "parts", "key", True)
    discard(rest)
    done = done.unionByName(_round(left, seqs, "settled1"))
    return done.dropDuplicates(["fp", "s", "e", "lead", "ls", "le"])


def repeated_passages(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of LEAST_WORDS words or more that another document has, too, at a similarity of SIMILARITY or more over
    five-word shingles.

    Returns doc_id, start_word, end_word (exclusive), other_doc_id, other_start, other_end, similarity: one row per
    document and passage, against the representative of the class that shares it; the representative's rows name the
    smallest document of those that share it with it. Equal word sequences are one document for this: each copy has the
    passages of the sequence and, besides, one row for the whole text against the smallest id. Words are cut at white
    space, A-Z counting as a-z. Null, empty and shorter texts have no passages. A null doc_id is kept in its rows."""
    every = written(windows(docs, text_col, doc_col), "windows")
    known = written(every.where("n is not null").select("doc_id", "fp", "n"), "known")
    nodes = written(known.where(F.col("fp").isNotNull() & (F.col("n") >= LEAST_WORDS)).groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").cast("int").alias("n")), "nodes")
    rows = every.where("key is not null").select("key", "fp", "c", "reach", "which")
    # tables, so that the joins have a plain shuffle on either side and Spark can split a shingle that many sequences share
    sizes = written(rows.groupBy("key").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead <> last").drop("last"), "sizes")
    shared = written(rows.join(sizes, "key"), "shared")
    discard(every, sizes)
    centres = written(shared.where("fp = lead").groupBy("key").agg(F.min("c").alias("lc"), F.min_by("reach", "c").alias("lreach")), "centres")
    match = F.struct("c", "reach", F.col("lc").alias("k"), F.col("lreach").alias("s"), F.col("which").alias("f"))
    pairs = shared.where("fp <> lead").join(centres, "key").groupBy("fp", "lead").agg(F.collect_set(match).alias("matches"), F.count_distinct("which").alias("agree")).where(F.col("agree") >= ENOUGH).drop("agree")
    pairs = written(pairs, "pairs")
    minima = written(shared.groupBy("fp").agg(F.collect_set("c").alias("cs")), "minima")
    discard(shared, centres)
    wanted = nodes.join(minima.select("fp"), "fp", "left_semi")
    size = 4 * (wanted.agg(F.sum("n")).head()[0] or 0)
    seqs = bucketed(_sequences(docs, wanted.select("rep"), doc_col, text_col).dropDuplicates(["fp"]), "fp", "sequences", size // BUCKET_BYTES + 1)
    found = written(_verified(_sides(pairs, seqs, "pairs").withColumn("diagonals", F.lit(None))), "verified")
    discard(pairs)
    held = found.unionByName(_swapped(found))
    # a centre has passages with many; from each place the longest one covers the others
    from_centres = found.groupBy(F.col("lead").alias("fp"), F.col("ls").alias("s")).agg(F.max("le").alias("e")).withColumn("runs", F.lit(None).cast("array<int>"))
    spread = found.select("fp", "s", "e", "runs").unionByName(from_centres).groupBy("fp").agg(F.collect_set(F.struct("s", "e", "runs")).alias("held"))
    spread = written(spread, "spread")
    around = lambda rows: rows.join(spread, "fp", "left").join(seqs, "fp")
    grams = written(_around(around(minima), grams_at, "gram c open"), "grams")
    kept = _met(grams, "kept", "gram").groupBy("fp").agg(F.collect_set("c").alias("cs"))
    spans = written(_around(around(kept), spans_around, "span inner s t open"), "around")
    discard(grams)
    more = written(_settled(spans, seqs), "more")
    discard(seqs)
    # not again what both documents have already
    more = _uncovered(more, held, "s", "e").unionByName(_swapped(_uncovered(_swapped(more), held, "s", "e"))).drop("runs").distinct()
    found = written(found.drop("runs").unionByName(more), "passages")
    # the representatives' side, once per distinct passage
    mirrored = found.groupBy(F.col("lead").alias("fp"), F.col("ls").alias("s"), F.col("le").alias("e")).agg(F.min("fp").alias("lead"), F.min_by(F.struct("s", "e", "similarity"), "fp").alias("o"))
    mirrored = mirrored.select("fp", "s", "e", "lead", F.col("o.s").alias("ls"), F.col("o.e").alias("le"), F.col("o.similarity").alias("similarity"))
    both = found.unionByName(mirrored)
    named = both.join(nodes.select(F.col("fp").alias("lead"), F.col("rep").alias("other_doc_id")), "lead").select("fp", "s", "e", "other_doc_id", F.col("ls").alias("os"), F.col("le").alias("oe"), "similarity")
    copies = nodes.where("copies > 1").select("fp", F.lit(0).alias("s"), F.col("n").alias("e"), F.col("rep").alias("other_doc_id"), F.lit(0).alias("os"), F.col("n").alias("oe"), F.lit(1.0).alias("similarity"))
    out = known.select("doc_id", "fp").join(named.unionByName(copies), "fp")
    return out.select("doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), "other_doc_id", F.col("os").alias("other_start"), F.col("oe").alias("other_end"), "similarity")


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents: doc_id, start_word, end_word, other_doc_id,
    other_start, other_end, similarity."""
    return repeated_passages(table(spark, sf_dir, "documents"))
