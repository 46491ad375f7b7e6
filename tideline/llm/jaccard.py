"""An n-gram Jaccard join with adaptive multi-match prefixes.

All shingles have one global order, frequent ones last. Two sets that are similar enough share a shingle in short
prefixes of that order, and l shingles in prefixes that are l - 1 longer. Each document takes the l for which its
estimated candidates cost least; a pair becomes a candidate only with as many shared prefix shingles as the shorter
requirement of the two, and as many as the overlap that is left to find demands. The order only decides about speed:
any order gives all links.

Equal sets are one node. A prefix shingle of few nodes gives their pairs, one of more nodes those that connect whatever
could be linked, one of very many nodes a star, so that the rows stay linear in the input however large a group of copies
is. Parity sketches bound the symmetric difference of two sets from below; a pair whose sketches differ by more than a link
allows can't be linked and is no edge, or else chance matches grow into groups of most of the corpus. The components of
these edges are groups that no link leaves; inside a group all pairs that are not yet known to be connected are compared
exactly, in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, ddl, discard, forget_shuffles, listed, mix, shingle_hashes, table, text_chunks, utf8, with_text, word_hashes, word_spans, written
from .components import components

#: Shared prefix shingles of more nodes than this give no pairs to be counted: up to the second number the sketches of
#: their nodes are compared in one place, beyond it they give a star.
PAIRS_UP_TO, SKETCHED_UP_TO = 24, 2048
#: Bits of a parity sketch: the power of two that isn't below the set's size, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Longest multi-match requirement that a document considers, and the cost of verifying a candidate in postings.
MOST_MATCHES, VERIFY_COST = 8, 50
#: Shingles are counted locally in so many classes by their hashes, so many of a class at a time; those seen this often are
#: reported. Classes make the window, in which a shingle can be seen again, as many times longer than what is sorted.
COUNT_CLASSES, COUNT_WINDOW, REPORTED = 4, 1_500_000, 2
#: Frequent shingles in the global order's table, at most (16 bytes each); others count as rare.
FREQUENT = 1 << 18
#: Prefix rows that are shuffled at a time, about, and the most steps that are made of them.
STEP_ROWS, MOST_STEPS = 10_000_000, 8
#: Bytes of shingle sets in a tile's block, and what a set counts beside its shingles, which bounds the sets in a block.
TILE_BYTES, SET_BYTES = 12_000_000, 600


class Shingles:
    """The shingle sets of a chunk of texts."""

    def __init__(self, k: int):
        self.k = k

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Of each text its distinct shingles in the order of their hashes; all words as one, if they are fewer."""
        data, offsets = utf8(column)
        starts, ends, first = word_spans(data, offsets, NOT_SPACE)
        words = word_hashes(data, starts, ends, LOWER)
        every = shingle_hashes(words, self.k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.k:
                yield np.unique(every[a : b - self.k + 1])
            else:
                yield shingle_hashes(words[a:b], b - a) if b > a else every[:0]


def fingerprint(shingles: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, signed; with 10^9 different sets the odds of any two meeting are about 1 in 40."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) ^ np.uint64(len(shingles))]))[0].astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """Which of so many bits an odd number of shingles falls on. Half of the bits, xor the other half, is the sketch of half
    as many bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Sketch:
    """A sketch as a number, with the smaller ones that were asked for."""

    def __init__(self, data: bytes, n: int):
        self.n, self.bits = n, 8 * len(data)
        self.of = {self.bits: int.from_bytes(data, "little")}

    def at(self, bits: int) -> int:
        if bits not in self.of:
            wide = self.at(2 * bits)
            self.of[bits] = (wide ^ (wide >> bits)) & ((1 << bits) - 1)
        return self.of[bits]

    def may_link(self, other: _Sketch, percent: int) -> bool:
        """False only if the sets can't be linked: each differing bit is a shingle that one of them has alone."""
        total = self.n + other.n
        bits = min(self.bits, other.bits)
        return (self.at(bits) ^ other.at(bits)).bit_count() <= total - 2 * -(-percent * total // (100 + percent))


def described(docs: DataFrame, k: int, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, fp long and sketch binary (null for empty sets) and n long of each row, and besides rows with
    token and seen, which tell the shingles that are locally frequent."""
    picked = with_text(docs, keep, text_col)
    kinds = ddl(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "fp", "n", "sketch", "token", "seen"]
        held: list[list[np.ndarray]] = [[] for _ in range(COUNT_CLASSES)]
        sizes = [0] * COUNT_CLASSES
        schema = None

        def frequent(k: int) -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held[k]), return_counts=True)
            token, seen = token[seen >= REPORTED], seen[seen >= REPORTED]
            held[k], sizes[k] = [], 0
            none = [pa.nulls(len(token), f.type) for f in schema]
            return pa.RecordBatch.from_arrays([*none, pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(seen)], names=names)

        for chunk in text_chunks(batches):
            schema = list(chunk.schema)[:-1]
            sets = list(Shingles(k).sets(chunk.column(chunk.num_columns - 1)))
            m = chunk.num_rows
            fp, n = [fingerprint(x) if len(x) else None for x in sets], [len(x) for x in sets]
            sketches = pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(fp, pa.int64()), pa.array(n, pa.int64()), sketches, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            every = np.concatenate(sets)
            which = every % np.uint64(COUNT_CLASSES)
            for c in range(COUNT_CLASSES):
                held[c].append(every[which == c])
                sizes[c] += len(held[c][-1])
                if sizes[c] >= COUNT_WINDOW:
                    yield frequent(c)
        for c in range(COUNT_CLASSES):
            if sizes[c]:
                yield frequent(c)

    return picked.mapInArrow(run, f"{kinds}fp long, n long, sketch binary, token long, seen long")


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, percent: int, text_col: str) -> DataFrame:
    """(token, fp, n, need) for each shingle in the prefix of each distinct set: ``need`` is the l of the document. A
    task emits a set once; several tasks may emit it, too."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        done: set[int] = set()
        for chunk in text_chunks(batches):
            parts, fps, ns, needs, sizes = [], [], [], [], []
            for s in Shingles(k).sets(chunk.column(0)):
                n = len(s)
                fp = fingerprint(s) if n else None
                if not n or fp in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(fp)
                cost = np.zeros(n)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    cost = np.where(tokens[at] == s, counts[at], 0.0)
                    if cost.any():
                        order = np.argsort(cost, kind="stable")
                        s, cost = s[order], cost[order]
                base = n - -(-percent * n // 100) + 1
                need = 1
                lists = np.cumsum(cost[: base + MOST_MATCHES - 1])
                if lists[-1] > 0:
                    l = np.arange(1, min(MOST_MATCHES, n - base + 1) + 1)  # noqa: E741
                    postings = lists[base + l - 2]
                    need = int(l[np.argmin(postings + VERIFY_COST * postings / l)])
                parts.append(s[: base + need - 1])
                fps.append(fp)
                ns.append(n)
                needs.append(need)
                sizes.append(base + need - 1)
            if parts:
                spread = lambda x, t: pa.array(np.repeat(np.array(x, t), sizes))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), spread(fps, np.int64), spread(ns, np.int64), spread(needs, np.int32)], names=["token", "fp", "n", "need"])

    return docs.select(docs[text_col].cast("string").alias("__text")).mapInArrow(run, "token long, fp long, n long, need int")


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): of the sets of each token, edges that connect all pairs whose sketches allow a link. ``rows``: token long, fp
    long, n long, sketch binary; SKETCHED_UP_TO sets of a token at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies share many tokens
        for group in _runs(batches):
            fps = group.column("fp").to_numpy()
            key = hashlib.sha256(fps.tobytes()).digest()
            if key in done:
                continue
            if len(done) > 100_000:
                done.clear()
            done.add(key)
            every = [_Sketch(d, n) for d, n in zip(group.column("sketch").to_pylist(), group.column("n").to_pylist(), strict=True)]
            union, edges = _Union(len(every)), []
            for x, one in enumerate(every):  # in the order of their sizes
                for y in range(x + 1, len(every)):
                    if 100 * one.n < percent * every[y].n:
                        break
                    if union.label[x] != union.label[y] and one.may_link(every[y], percent):
                        union.join(x, y)
                        edges.append((x, y))
            if edges:
                both = fps[np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return rows.select("token", "fp", "n", "sketch").repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(run, "a long, b long")


def _allowed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    side = lambda p: nodes.select(*(F.col(c).alias(f"{p}{c}") for c in ("fp", "n", "sketch")))
    both = pairs.join(side("x"), F.col("a") == F.col("xfp")).join(side("y"), F.col("b") == F.col("yfp")).select("a", "b", "xn", "xsketch", "yn", "ysketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, *columns = (c.to_pylist() for c in batch.columns)
            good = [_Sketch(xs, xn).may_link(_Sketch(ys, yn), percent) for xn, xs, yn, ys in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def shared_prefixes(heads: DataFrame) -> list[DataFrame]:
    """(token, fp, n, need, lead, size) of the prefix shingles that several sets share, each set once: tables that
    ``written`` made, one for each class of tokens. Most prefix shingles have one set only and end here; class by class,
    so that never more than a class of them is on the disk as shuffles."""
    steps = min(MOST_STEPS, 1 + heads.count() // STEP_ROWS)
    return [_shared(heads.where(F.pmod("token", F.lit(steps)) == step) if steps > 1 else heads) for step in range(steps)]


def _shared(rows: DataFrame) -> DataFrame:
    # tables, so that the joins have a plain shuffle on either side and Spark can split a shingle that many sets share
    several = written(rows.groupBy("token").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead <> last").select("token", "lead"), "several")
    forget_shuffles(rows.sparkSession)  # this one and the next hold all prefixes of the class
    # what is left is small; only here the copies of a set that other tasks emitted go, and sets are counted
    raw = written(rows.join(several, "token"), "raw")
    forget_shuffles(rows.sparkSession)
    once = written(raw.dropDuplicates(["token", "fp"]), "once")
    discard(several, raw)
    sizes = written(once.groupBy("token").agg(F.count("*").alias("size")), "sizes")
    shared = written(once.join(sizes, "token"), "shared")
    discard(once, sizes)
    return shared


def candidate_edges(parts: list[DataFrame], nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets with enough shared prefix shingles, edges between the sets that share a frequent one, and stars
    over those that very many sets share. Whatever two sets are linked, the edges connect them. ``parts``: what
    shared_prefixes gives; they are deleted. ``nodes``: fp, n, sketch."""
    shared = reduce(DataFrame.unionByName, parts)
    stars = shared.where(F.col("size") > SKETCHED_UP_TO).where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    some = shared.where((F.col("size") > PAIRS_UP_TO) & (F.col("size") <= SKETCHED_UP_TO)).select("token", "fp")
    met = _meeting(some.join(nodes.select("fp", "n", "sketch"), "fp"), percent)
    few = shared.where(F.col("size") <= PAIRS_UP_TO)
    members = F.array_sort(F.collect_list(F.struct("fp", "n", "need")))  # PAIRS_UP_TO at most
    pairs = few.groupBy("token").agg(members.alias("m")).select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y["fp"] > F.col("x.fp"))).alias("y"))
    pairs = pairs.where((100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    counted = pairs.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count("*").alias("c"), *(F.min(f"{p}.{c}").alias(f"{p}{c}") for p in "xy" for c in ("n", "need")))
    # sets that also meet in a frequent shingle are connected there; their count here may be short of what they share
    rest = lambda p: F.ceil(F.col(f"{p}n") * percent / 100) - F.col(f"{p}need")  # noqa: E731  beyond the prefix
    overlap = F.ceil((F.col("xn") + F.col("yn")) * percent / (100 + percent) - 1e-9)
    enough = (F.col("c") >= F.least("xneed", "yneed")) & (F.col("c") >= overlap - F.greatest(rest("x"), rest("y")))
    found = written(counted.where(enough).select("a", "b"), "pairs")
    edges = written(stars.unionByName(met).distinct().unionByName(_allowed(found, nodes, percent)), "edges")
    discard(*parts, found)
    return edges


class _Union:
    """Disjoint sets over 0..n-1; the smaller of two that join takes the label of the larger."""

    def __init__(self, n: int):
        self.label = list(range(n))
        self.members = {k: [k] for k in range(n)}
        self.largest = 0

    def join(self, x: int, y: int) -> bool:
        a, b = self.label[x], self.label[y]
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        for k in self.members[b]:
            self.label[k] = a
        self.members[a] += self.members.pop(b)
        if self.largest == b or len(self.members[a]) > len(self.members[self.largest]):
            self.largest = a
        return True


def _linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def spanning_links(sets: list[np.ndarray], is_query: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect whatever all links with an end in a query connect.

    A set is compared with all that share a shingle with it at once, by inverted lists. If all sets are queries, those of
    the largest component so far are left out: pairs inside it don't matter, and all others are compared with them."""
    size = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    if n < 2:
        return []
    owner, begin = np.repeat(np.arange(n), size), np.append(0, np.cumsum(size))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    common = np.bincount(token)
    # inverted lists of the shingles that more than one set has
    lists, first = owner[np.argsort(token, kind="stable")], np.append(0, np.cumsum(common))
    # the centre of a group of copies shares most with the others
    weight = np.bincount(owner, common[token] - 1, minlength=n) / size
    union, links, whole = _Union(n), [], bool(is_query.all())
    order = [x for x in np.argsort(-weight, kind="stable").tolist() if is_query[x] and weight[x] > 0]
    while order:
        later = []
        for x in order:
            if whole and union.label[x] == union.largest and len(union.members[union.largest]) > 1:
                later.append(x)
                continue
            mine = token[begin[x] : begin[x + 1]]
            mine = mine[common[mine] > 1]
            low, many = first[mine], common[mine]
            ends = np.cumsum(many)
            others, inter = np.unique(lists[np.repeat(low - (ends - many), many) + np.arange(ends[-1])], return_counts=True)
            for y in others[_linked(inter, size[x], size[others], percent)].tolist():
                if union.join(x, y):
                    links.append((x, y))
        if all(union.label[x] == union.largest for x in later):
            return links
        order = later
    return links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with equal first column, of sorted input; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(cut, cut[1:], strict=False):
            if low == high:
                continue
            if held and held[0].column(0)[0].as_py() != key[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links of each tile. ``rows``: tile long, fp long, query boolean, tokens binary. Tiles have
    bounded sizes; a task takes its tiles one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for tile in _runs(batches):
            fps, first, back = np.unique(tile.column("fp").to_numpy(), return_index=True, return_inverse=True)
            tokens = tile.column("tokens")
            sets = [np.frombuffer(tokens[int(k)].as_py(), np.uint64) for k in first]
            query = np.bincount(back, tile.column("query").to_numpy()) > 0
            links = spanning_links(sets, query, percent)
            if links:
                out.append(fps[np.array(links)])
            if sum(map(len, out)) > 50_000:
                both = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
                out = []
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return rows.select("tile", "fp", "query", "tokens").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, doc_col: str, text_col: str) -> DataFrame:
    """(fp, tokens) of the documents whose ids are listed. Few ids go to the texts, else the texts to the ids."""
    rows = docs.select(docs[doc_col].alias("id"), docs[text_col].cast("string").alias("__text"))
    rows = listed(rows, "id", ids.select("rep")).select("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=2_000_000):
            sets = [s for s in Shingles(k).sets(chunk.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "tokens"])

    return rows.mapInArrow(run, "fp long, tokens binary")


def _by_length(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` with the labels of large groups replaced: sets can only link if their sizes lie in the same class of sizes
    or in neighbouring ones, so that a large group falls into groups of two neighbouring classes, each set in two."""
    large = sets.groupBy("label").agg(F.sum(F.octet_length("tokens") + SET_BYTES).alias("size")).where(F.col("size") > TILE_BYTES).select("label")
    large = written(large, "large")
    few = large.count()
    if not few:
        return sets
    hint = lambda df: F.broadcast(df) if few <= 100_000 else df
    size_class = F.floor(F.log(F.octet_length("tokens") / 8) / np.log(100 / percent) / 1.0001)
    split = sets.join(hint(large), "label", "left_semi").withColumn("__j", F.explode(F.array(size_class - 1, size_class)))
    split = split.select("fp", F.xxhash64("label", "__j").alias("label"), "tokens")
    return written(sets.join(hint(large), "label", "left_anti").select("fp", "label", "tokens").unionByName(split), "split")


def _links(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all that is linked. ``sets``: fp, label, tokens; a label's links stay inside it."""
    sets = _by_length(sets, percent)
    bytes_of = sets.groupBy("label").agg(F.sum(F.octet_length("tokens") + SET_BYTES).alias("size"))
    blocks = written(bytes_of.select("label", F.ceil(F.col("size") / TILE_BYTES).cast("int").alias("nb")).where("nb > 1"), "blocks")
    tile = lambda *c: F.xxhash64(*c)
    few = blocks.count()
    if not few:
        return tile_links(sets.select(F.col("label").alias("tile"), "fp", F.lit(True).alias("query"), "tokens"), percent)
    small = sets.join(F.broadcast(blocks) if few <= 100_000 else blocks, "label", "left_anti")
    found = tile_links(small.select(F.col("label").alias("tile"), "fp", F.lit(True).alias("query"), "tokens"), percent)
    large = written(sets.join(F.broadcast(blocks) if few <= 100_000 else blocks, "label").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")), "members")
    # first a few central sets of each large group against all its blocks ...
    degree = edges.select(F.col("b").alias("fp")).unionByName(edges.select(F.col("a").alias("fp"))).groupBy("fp").agg(F.count("*").alias("d"))
    known = large.select("fp", "label").join(degree, "fp")
    centres = known.groupBy("label").agg(F.array_distinct(F.array(F.max_by("fp", "d"), F.min("fp"))).alias("c")).select("label", F.explode("c").alias("fp"))
    as_query = large.join(centres, ["label", "fp"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    shape = lambda df, q, *c: df.select(tile(*c).alias("tile"), "fp", F.lit(q).alias("query"), "tokens")
    star = written(tile_links(shape(large, False, "label", "block").unionByName(shape(as_query, True, "label", "block")), percent), "star")
    # ... then the sets outside the largest component of their group against all blocks
    part = components(star)
    member = large.select("fp", "label", (F.octet_length("tokens") + SET_BYTES).alias("size")).join(part.withColumnRenamed("label", "part").withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    biggest = member.groupBy("label", "part").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("part", "n").alias("main"))
    open_ = member.join(biggest, "label").where("part <> main")
    many = open_.groupBy("label").agg(F.ceil(F.sum("size") / TILE_BYTES).cast("int").alias("nq"))
    asked = large.join(open_.select("label", "fp"), ["label", "fp"], "left_semi").join(many, "label")
    asked = asked.select("*", F.pmod(F.xxhash64(F.lit("q"), "fp"), F.col("nq")).cast("int").alias("q")).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    others = large.join(many, "label").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    rest = tile_links(shape(others, False, "label", "q", "block").unionByName(shape(asked, True, "label", "q", "block")), percent)
    return found.unionByName(star).unionByName(rest)


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that links connect: two documents link when the Jaccard similarity of their sets of
    ``k``-word shingles is ``percent`` or more.

    Returns one row per row of ``docs``: doc_id, n_shingles long (size of the set), component_id (smallest doc_id that
    links reach, itself included). Words are cut at white space, A-Z counting as a-z; a text of fewer than ``k`` words
    has one shingle, all its words; a text without words, or null, has none and is a class of its own. Equal sets are
    always linked. A null doc_id takes part in links but never names a class, unless all ids of a class are null."""
    return _classed(docs, k, percent, doc_col, text_col).select("doc_id", "n_shingles", "component_id")


def _classed(docs: DataFrame, k: int, percent: int, doc_col: str, text_col: str) -> DataFrame:
    """near_copies, and with each row fp (of its set) and label (of its class), null for texts without words."""
    desc = written(described(docs, k, text_col, (doc_col,)).withColumnRenamed(doc_col, "doc_id"), "described")
    seen = desc.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    seen = written(seen, "seen")
    levels = {r[0]: r[1] for r in seen.groupBy(F.floor(F.log2("seen") * 2).cast("int")).count().collect()}  # a few dozen
    least, total = None, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > FREQUENT:
            break
        least = level
    picked = seen.where(F.floor(F.log2("seen") * 2) >= least).toArrow() if least is not None else None
    frequent = (np.zeros(0, np.uint64), np.zeros(0))
    if picked is not None:
        token = picked.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        frequent = token[order], picked.column("seen").to_numpy().astype(np.float64)[order]
    rows = desc.where("n is not null")
    nodes = written(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    heads = written(prefixes(docs, frequent, k, percent, text_col), "prefixes")
    shared = shared_prefixes(heads)
    discard(seen, heads)
    edges = candidate_edges(shared, nodes, percent)
    groups = written(components(edges).withColumnRenamed("node", "fp").join(nodes.select("fp", "rep"), "fp"), "groups")
    found = _sets_of(docs, groups, k, doc_col, text_col).groupBy("fp").agg(F.first("tokens").alias("tokens"))
    sets = written(found.join(groups.select("fp", "label"), "fp"), "sets")
    linked = components(written(_links(sets, edges, percent), "links")).withColumnRenamed("node", "fp")
    named = written(linked.join(groups.select("fp", "rep"), "fp"), "linked")
    classes = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "label", "component_id")
    # a table, so that the join below has a plain shuffle on either side and Spark can split a set that many rows share
    known = written(nodes.select("fp", "rep").join(classes, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "rep").alias("component_id")), "known")
    discard(nodes, edges, groups, sets, named)
    return rows.join(known, "fp", "left").select("doc_id", "fp", "label", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_copies(docs: DataFrame, k: int = 5, percent: int = 80, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near_copies, that of the smallest id; columns as they are. Rows with null
    ids go if their class has another; of rows that share the kept id one stays. Texts without words stay."""
    found = written(_classed(docs, k, percent, doc_col, text_col), "classes")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    few = gone.count()
    gone = F.broadcast(gone) if few <= 1_000_000 else gone
    kept = docs.join(gone, docs[doc_col] == gone["__gone"], "left_anti")
    twice = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")), "twice")
    many = twice.count()
    if not many and not found.where("doc_id is null and fp is not null").limit(1).count():
        return kept
    # ids don't tell rows without one, or with a repeated one, apart: their sets do
    hint = F.broadcast(twice) if many <= 1_000_000 else twice
    kept = kept.join(hint, kept[doc_col] == hint["__twice"], "left_anti").where(kept[doc_col].isNotNull())
    rest = docs.where(docs[doc_col].isNull()).unionByName(docs.join(hint, docs[doc_col] == hint["__twice"], "left_semi"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(doc_col)], names[docs.columns.index(text_col)]
    rest = described(rest.toDF(*names), k, text, tuple(names)).where("n is not null")
    chosen = found.where("fp is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "fp")).alias("x"))
    chosen = chosen.select(F.col("x.id").alias("__id"), F.col("x.fp").alias("__fp"))
    one = rest.join(chosen, rest["fp"].eqNullSafe(chosen["__fp"]) & rest[key].eqNullSafe(chosen["__id"]), "left_semi").dropDuplicates([key, "fp"])
    back = one.unionByName(rest.where("fp is null")).select(*names).toDF(*docs.columns)
    return kept.unionByName(back)


def op9_adaptive_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents over four-word shingles at 0.85: doc_id, n_shingles, component_id."""
    return near_copies(table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id
"""
