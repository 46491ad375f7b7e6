"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Unit vectors are rotated (principal axes, then a rotation that brings the coordinates close to signs, found by
alternating least squares); the signs are the code, over several rotations where the dimension is below the code's
length. A code is split into substrings of 16 bits. The index is dealt into shards, each with a bucket directory for every
substring. Two codes within a Hamming radius agree in some substring up to the radius' share of it, so that looking up the
buckets of all values within that share retrieves every code within the radius; what is found is reranked by the cosine
of the original vectors. Queries that find too few are searched again without a radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BITS, PIECE = 128, 16
#: Vectors in the fit of the rotations and of the radius, about.
FIT_ROWS = 12_000
#: Share of the sample's true neighbours that the radius must cover.
COVERED = 0.98
#: Bytes of the vectors in a shard of the index, at most, and rows in a shard where fewer shards would leave cores idle.
SHARD_BYTES, SHARD_ROWS = 64_000_000, 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by their largest parts first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Rotations and the radius, learned from a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        self.mean = x.mean(0)
        d = x.shape[1]
        axes = np.linalg.svd(x - self.mean, full_matrices=False)[2][: min(d, BITS)]
        y = (x - self.mean) @ axes.T
        self.rotations = []
        for _ in range(-(-BITS // len(axes))):
            r = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
            for _ in range(12):
                u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ v).T
            self.rotations.append(axes.T @ r)
        self.radius = BITS
        if len(x) > 4 * k:
            ask = np.arange(0, len(x), max(1, len(x) // 300))
            cos = x[ask] @ x.T
            cos[np.arange(len(ask)), ask] = -2
            near = np.argpartition(-cos, k, axis=1)[:, :k]
            codes = self.encode(x)
            far = np.stack([np.bitwise_count(codes[ask] ^ codes[near[:, j]]).sum(1) for j in range(k)])
            self.radius = int(np.quantile(far, COVERED, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of vectors as rows of two 64-bit numbers."""
        y = _unit(x) - self.mean
        bits = np.concatenate([y @ r >= 0 for r in self.rotations], 1)[:, :BITS]
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def shares(radius: int) -> list[int]:
    """The distance up to which each substring is probed: of two codes within ``radius`` some substring is as close."""
    m = BITS // PIECE
    return [radius // m - (j > radius % m) for j in range(m)]


def masks(share: int) -> np.ndarray:
    """All substrings within ``share`` bits of 0: what a probe flips."""
    every = np.arange(1 << PIECE, dtype=np.uint32)
    return every[np.bitwise_count(every) <= share].astype(np.uint16)


class Shard:
    """Rows of the index with a bucket directory for each substring: rows in the order of its values, and where the rows of
    each value begin."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.codes, self.unit = ids, codes, _unit(vectors)
        pieces = np.ascontiguousarray(codes).view(np.uint16)
        self.orders = [np.argsort(pieces[:, j], kind="stable") for j in range(pieces.shape[1])]
        self.begins = [np.append(0, np.cumsum(np.bincount(pieces[:, j], minlength=1 << PIECE))) for j in range(pieces.shape[1])]
        self.mark = np.zeros(len(ids), bool)

    def within(self, code: np.ndarray, radius: int, probes: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Rows whose codes are within ``radius`` of ``code``, and how many the buckets gave. ``probes`` are the masks of
        each substring."""
        if radius >= BITS:
            return np.arange(len(self.ids)), len(self.ids)
        for value, order, begin, flips in zip(np.ascontiguousarray(code).view(np.uint16), self.orders, self.begins, probes, strict=True):
            bucket = (value ^ flips).astype(np.int64)
            low = begin[bucket]
            size = begin[bucket + 1] - low
            some = size > 0
            low, size = low[some], size[some]
            ends = np.cumsum(size)
            if len(ends):
                self.mark[order[np.repeat(low - (ends - size), size) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(self.mark)
        self.mark[rows] = False
        far = np.bitwise_count(self.codes[rows, 0] ^ code[0]) + np.bitwise_count(self.codes[rows, 1] ^ code[1])
        return rows[far <= radius], len(rows)


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that isn't zero; v is array<double>."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _encoded(rows: DataFrame, model) -> DataFrame:
    """(id, v, code): every row with its code of BITS / 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.tobytes() for c in model.value.encode(_vectors(batch))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["id", "v", "code"])

    return rows.mapInArrow(run, "id long, v array<double>, code binary")


def _searched(index: DataFrame, asked: DataFrame, shards: int, radius: int, k: int) -> DataFrame:
    """query_id, vec_id, score, shard, candidates: of each query and shard the ``k`` best that its probes retrieve, and the
    rows that its buckets gave. One shuffle: a shard's rows and then the queries, which stream through, reach one task."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rows = index.select(F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v", "code")
    every = rows.unionByName(asked.select(spread.alias("shard"), F.lit(1).alias("asks"), "id", "v", "code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = [masks(share) for share in shares(min(radius, BITS))]
        held: list[tuple[np.ndarray, ...]] = []
        now, shard = None, None
        for batch in batches:
            place, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            vectors = _vectors(batch)
            codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            out: list[tuple[np.ndarray, ...]] = []
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if low == high:
                    continue
                if place[low] != now:
                    now, held, shard = place[low], [], None
                if not asks[low]:
                    held.append((ids[low:high], vectors[low:high], codes[low:high]))
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if shard is None:
                    continue
                unit = _unit(vectors[low:high])
                for q in range(low, high):
                    near, given = shard.within(codes[q], radius, probes)
                    near = near[shard.ids[near] != ids[q]]
                    score = np.einsum("ij,j->i", shard.unit[near], unit[q - low])  # row by row, so that equal rows tie exactly
                    if len(near) > k:  # all that tie with the k-th best, then by id
                        some = score >= np.partition(score, len(score) - k)[len(score) - k]
                        near, score = near[some], score[some]
                    order = np.lexsort((shard.ids[near], -score))[:k]
                    m = len(order)
                    out.append((np.full(m, ids[q]), shard.ids[near[order]], score[order], np.full(m, now), np.full(m, given)))
            if out:
                query, near, score, at, given = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64()), pa.array(at, pa.int32()), pa.array(given, pa.int64())], names=["query_id", "vec_id", "score", "shard", "candidates"])

    dealt = every.repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double, shard int, candidates long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: the best of all shards; k rows from each, joined in two steps."""
    packed = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    best = lambda x: F.slice(F.array_sort(x), 1, k)
    of_shard = found.groupBy("query_id", "shard").agg(best(F.collect_list(packed)).alias("t"), F.max("candidates").alias("n"))
    part = of_shard.groupBy("query_id", (F.col("shard") % 256).alias("g")).agg(best(F.flatten(F.collect_list("t"))).alias("t"), F.sum("n").alias("n"))
    top = part.groupBy("query_id").agg(best(F.flatten(F.collect_list("t"))).alias("t"), F.sum("n").alias("candidates"))
    return top.select("query_id", F.posexplode("t").alias("p", "x"), "candidates").select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"), "candidates")


RESULT = "query_id long, rank int, vec_id long, score double, candidates long"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each query by cosine: query_id long, rank int from 1, vec_id long, score double,
    candidates long (rows that its buckets gave, over all shards); ties go to the smaller id, and a query's own id is no
    candidate.

    Rows whose id or vector is null, or whose vector is zero, holds nulls or isn't finite, take no part. Vectors of each
    length are an index of their own, as no others can be compared with them. Equal vectors are as near as any; a row that
    repeats an id is a candidate like others, and of queries that repeat an id the least vector asks. Every row is
    indexed. The number of passes over the rows doesn't depend on the queries: each shard is built once, and all queries
    stream through it. Where true neighbours are hardly nearer than other rows, the radius grows until the buckets within
    its shares hold most rows; ``candidates`` tells."""
    spark = rows.sparkSession
    base = valid(rows, id_col, vector_col)
    asked = valid(queries, id_col, vector_col).groupBy("id", F.size("v").alias("d")).agg(F.min("v").alias("v"))
    out = spark.createDataFrame([], RESULT)
    for d, n in sorted(tuple(r) for r in base.groupBy(F.size("v")).count().collect()):
        out = out.unionByName(_of_length(base.where(F.size("v") == d), asked.where(F.col("d") == d).drop("d"), d, n, k, sample_rows))
    return out


def _of_length(base: DataFrame, asked: DataFrame, d: int, n: int, k: int, sample_rows: int) -> DataFrame:
    """``nearest`` for the ``n`` vectors of length ``d``."""
    spark = base.sparkSession
    spot = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 31))
    sample = [r.v for r in base.where(spot < int((1 << 31) * min(1.0, sample_rows / n)) + 1).limit(2 * sample_rows).select("v").collect()]
    codes = Codes(np.array(sample or [r.v for r in base.select("v").limit(2).collect()]), k)
    model = spark.sparkContext.broadcast(codes)
    index = written(_encoded(base, model), "codes")
    asked = written(_encoded(asked.select("id", "v"), model), "asked")
    shards = max(-(-n * 8 * d // SHARD_BYTES), min(-(-n // SHARD_ROWS), 2 * spark.sparkContext.defaultParallelism))
    first = written(_ranked(_searched(index, asked, shards, codes.radius, k), k), "nearest")
    if codes.radius >= BITS:
        return first
    full = first.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
    again = written(asked.join(full, asked["id"] == F.col("query_id"), "left_anti"), "again")
    if not again.limit(1).count():
        return first
    second = _ranked(_searched(index, again, shards, BITS, k), k)
    return first.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(second)


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector: query_id, rank, vec_id, score, candidates."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
