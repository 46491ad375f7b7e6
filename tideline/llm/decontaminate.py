"""Benchmark decontamination by suffix arrays over the training texts.

Each shard (a chunk of whole documents inside one task) gets a suffix array over its words; every suffix of every
benchmark item is binary-searched in it, all in step with each other. Neighbours of the insertion point give the longest
verbatim match and its place; the suffixes that begin with a window give all places where the window occurs. Words that
no item has can't be part of a match, so that only the runs between them enter the array. Documents are never
shuffled; the benchmark comes in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cols, ddl, table, text_chunks, unused, utf8, with_text

WINDOW = 13
#: Bytes of benchmark texts in one broadcast block; a larger benchmark has more blocks, not larger ones.
BLOCK_BYTES = 32_000_000

#: Bytes to words: A-Z to a-z, 0-9, a-z and all beyond ASCII stay, every other byte becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return raw.translate(_WORD_BYTES).split()


class Items:
    """The words of a block of benchmark items as numbers, each item ended by a 0; number 0 is no word."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        seq, item, wins = [], [], []
        for name, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            words = words_of((text or "").encode())
            if not words:
                continue
            k = len(self.names)
            self.names.append(name)
            w = min(window, len(words))
            seq += [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words] + [0]
            item += [k] * (len(words) + 1)
            wins += [w] * (len(words) - w + 1) + [0] * w  # 0: no window begins here
        self.seq, self.item, self.win = np.array(seq, np.int32), np.array(item, np.int32), np.array(wins, np.int32)
        self.least = int(self.win[self.win > 0].min()) if len(self.names) else 0


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order, by doubling the length of the sorted prefix until all differ."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.append(0, np.cumsum(key[1:] != key[:-1])) if n else key
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        step *= 2


def compare(b: np.ndarray, q: np.ndarray, s: np.ndarray, p: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise order (-1, 0, 1) of suffixes of ``b`` at ``q`` against those of ``s`` at ``p``, and the length of their
    common prefix; 0 if they agree on the first ``most`` words."""
    sign, same = np.zeros(len(q), np.int8), np.zeros(len(q), np.int64)
    left, depth = np.arange(len(q)), 0
    while len(left):
        if most is not None:
            over = most[left] <= depth
            same[left[over]] = depth
            left = left[~over]
        x, y = b[q[left] + depth], s[p[left] + depth]
        differ = x != y
        gone = left[differ]
        sign[gone] = np.where(x[differ] < y[differ], -1, 1)
        same[gone] = depth
        left = left[~differ]
        depth += 1
    return sign, same


def bound(b: np.ndarray, q: np.ndarray, s: np.ndarray, order: np.ndarray, most: np.ndarray | None = None, after: bool = False) -> np.ndarray:
    """For each suffix of ``b`` at ``q`` how many suffixes of ``s`` are smaller (``after``: or equal in ``most`` words)."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    left = np.flatnonzero(low < high)
    while len(left):
        mid = (low[left] + high[left]) // 2
        sign, _ = compare(b, q[left], s, order[mid], None if most is None else most[left])
        up = (sign >= 0) if after else (sign > 0)
        low[left[up]] = mid[up] + 1
        high[left[~up]] = mid[~up]
        left = left[low[left] < high[left]]
    return low


class Shard:
    """The runs of item words in a chunk of documents, with their suffix array."""

    def __init__(self, items: Items, words: list[list[bytes]], starts: np.ndarray):
        get = items.numbers.get
        total = int(starts[-1])
        flat = np.fromiter((n for doc in words for n in map(get, doc, repeat(0))), np.int32, total)
        # runs of known words inside a document
        known = np.zeros(total + 2, np.int8)
        known[1:-1] = flat > 0
        change = np.diff(known)
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        cuts = np.unique(starts[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < total)]
        cuts = cuts[(known[cuts] == 1) & (known[cuts + 1] == 1)]
        first, last = np.sort(np.append(first, cuts)), np.sort(np.append(last, cuts))
        long = last - first >= max(1, items.least)
        first, last = first[long], last[long]
        size = last - first + 1  # with the end mark
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        self.place = np.repeat(first - (ends - size), size) + np.arange(n)  # in the chunk's words
        self.seq = np.zeros(n, np.int32)
        body = np.ones(n, bool)
        body[ends - 1] = False
        self.seq[body] = flat[self.place[body]]
        self.seq[~body] = -1 - np.arange(len(ends))  # end marks differ from each other and from all words
        self.order = suffix_array(self.seq) if n else np.zeros(0, np.int64)

    def longest(self, items: Items, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each item suffix with a match of ``least`` words or more: its place, the longest match, where it is."""
        q = np.flatnonzero(items.seq > 0)
        if not len(self.order) or not len(q):
            return (np.zeros(0, np.int64),) * 3
        at = bound(items.seq, q, self.seq, self.order)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(self.order) - 1)])
        same = np.stack([compare(items.seq, q, self.seq, self.order[x])[1] for x in near])
        best = np.argmax(same, axis=0)
        size, place = same[best, np.arange(len(q))], self.order[near[best, np.arange(len(q))]]
        hit = size >= least
        return q[hit], size[hit], self.place[place[hit]]

    def windows(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur: their places in the items, their first and last rank plus one, their lengths."""
        if not len(self.order):
            return (np.zeros(0, np.int64),) * 4
        q, size, _ = self.longest(items, max(1, items.least))
        hit = (items.win[q] > 0) & (size >= items.win[q])
        q = q[hit]
        most = items.win[q].astype(np.int64)
        return q, bound(items.seq, q, self.seq, self.order, most), bound(items.seq, q, self.seq, self.order, most, after=True), most


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, and the range of each."""
    size = high - low
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(low)), size)
    return np.repeat(low - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0), owner


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark as broadcasts of at most about ``block_bytes`` each, made one at a time on the driver."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = 1 + total // block_bytes
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows.where(part == k).collect()], window)) for k in range(n)]


def _words(texts: pa.Array) -> tuple[list[list[bytes]], np.ndarray]:
    data, offsets = utf8(texts)
    raw = data.tobytes()
    words = [words_of(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return words, np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), prefix: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How much of each document stands in the benchmark.

    Returns the columns ``keep`` and, their names after ``prefix``: n_words long; n_hit long, the words inside any
    occurrence of a window of ``window`` consecutive item words (an item of fewer words is one window); items
    array<string>, the ids of items with such windows in order; contaminated boolean, n_hit > 0 and
    20 * n_hit >= n_words. Null and empty texts have no words and are never contaminated; an item without words has no
    windows; items that share an id count once, a null id is the empty text. Every row of ``docs`` gives one row."""
    parts = blocks(benchmark, item_col, item_text_col, window, block_bytes)
    picked = with_text(docs, keep, text_col)
    kinds = ddl(docs, keep)
    names = [*keep, *(prefix + c for c in ("n_words", "n_hit", "items", "contaminated"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words, starts = _words(chunk.column(chunk.num_columns - 1))
            covered = np.zeros(int(starts[-1]) + 1, bool)
            found: list[set[str]] = [set() for _ in words]
            for part in parts:
                items = part.value
                shard = Shard(items, words, starts)
                q, low, high, size = shard.windows(items)
                if not len(q):
                    continue
                # equal windows of several items have the same range: their places are looked at once
                same, first, owner = np.unique(np.stack([low, size]), axis=1, return_index=True, return_inverse=True)
                owner = owner.ravel()
                ranks, of = _spread(low[first], high[first])
                place = shard.place[shard.order[ranks]]
                depth = np.zeros(len(covered) + 1, np.int32)
                np.add.at(depth, place, 1)
                np.add.at(depth, place + size[first][of], -1)
                covered |= np.cumsum(depth)[:-1] > 0
                doc = np.searchsorted(starts, place, side="right") - 1
                by_range = np.unique(np.stack([of, doc]), axis=1)
                edge = np.searchsorted(by_range[0], np.arange(same.shape[1] + 1))
                for k, r in np.unique(np.stack([items.item[q], owner]), axis=1).T.tolist():
                    for d in by_range[1, edge[r] : edge[r + 1]].tolist():
                        found[d].add(items.names[k])
            total = np.append(0, np.cumsum(covered[:-1]))
            n_words = np.diff(starts)
            n_hit = total[starts[1:]] - total[starts[:-1]]
            out = [*chunk.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array((n_hit > 0) & (20 * n_hit >= n_words))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return picked.mapInArrow(run, f"{kinds}`{prefix}n_words` long, `{prefix}n_hit` long, `{prefix}items` array<string>, `{prefix}contaminated` boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every item suffix: item, item_word (its first word), n_words, and one place of
    it, doc (``doc_col`` as text) and doc_word; only matches of ``least`` words or more. Of equally long matches the
    one with the smallest (doc, doc_word) counts, inside a shard any."""
    parts = blocks(benchmark, item_col, item_text_col, least, block_bytes)
    picked = docs.select(docs[doc_col].cast("string").alias("doc"), docs[text_col].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words, starts = _words(chunk.column(1))
            for part in parts:
                items = part.value
                q, size, place = Shard(items, words, starts).longest(items, least)
                doc = np.searchsorted(starts, place, side="right") - 1
                first = np.searchsorted(items.item, items.item[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([items.names[k] for k in items.item[q].tolist()], pa.string()), pa.array(q - first, pa.int64()), pa.array(size, pa.int64()), chunk.column(0).take(pa.array(doc)), pa.array(place - starts[doc], pa.int64())],
                    names=["item", "item_word", "n_words", "doc", "doc_word"],
                )

    found = picked.mapInArrow(run, "item string, item_word long, n_words long, doc string, doc_word long")
    best = F.min_by(F.struct("n_words", "doc", "doc_word"), F.struct(-F.col("n_words"), "doc", "doc_word"))
    return found.groupBy("item", "item_word").agg(best.alias("b")).select("item", "item_word", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows; columns as they are."""
    names = docs.columns
    prefix = unused("__decon_", *names)
    marked = hits(docs, benchmark, keep=tuple(names), prefix=prefix, **options)
    return marked.where(~F.col(f"{prefix}contaminated")).select(*cols(names))


def op7_training_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i, w FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM bw
), dw AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k
), hit AS (
  SELECT dw.doc_id, dw.i, dw.k, win.item FROM dw JOIN win ON win.k = dw.k AND win.t = array_to_string(dw.w[dw.i:dw.i + dw.k - 1], ' ')
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
