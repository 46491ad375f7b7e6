"""Shared plumbing of the operators on text corpora: tables, shared storage, numpy kernels over word spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; a single longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of whole texts below ``sf_dir``. Texts can be long: from here on the session hands fewer
    rows at a time to Python and reads fewer at a time than by default, so that a batch stays small in the JVM and in the
    worker. Spark reads both settings when a query runs, after this returns, so they can't be put back here; a caller
    that minds sets its own values, smaller or larger, once the result is written."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.parquet.columnarReaderBatchSize", 1024)):
        if int(spark.conf.get(key)) > most:
            spark.conf.set(key, most)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set, a temporary one if the
    session is local, so that all its threads see it, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tideline/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and lost executors cost nothing of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def bucketed(df: DataFrame, key: str, name: str, partitions: int) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by ``key`` into ``partitions`` buckets, or as many as shuffles have, if
    those are more: a join by ``key`` reads it without a shuffle."""
    spark = df.sparkSession
    partitions = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path, table_ = scratch_path(spark, name), f"tideline_{uuid.uuid4().hex}"
    df.repartition(partitions, key).write.bucketBy(partitions, key).sortBy(key).option("path", path).saveAsTable(table_)
    out = spark.table(table_)
    out.scratch, out.table_name = path, table_
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` or ``bucketed`` made, and has the JVM tidy up, so that Spark removes the shuffles of
    finished steps, too. Only for tables from which nothing is computed any more: whatever was made of them has been
    written itself, so that no lost executor asks for them again."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "table_name"):
            spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        forget_shuffles(tables[0].sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Has the JVM tidy up, so that Spark removes the shuffles of what has been written."""
    spark._jvm.System.gc()


#: Ids that a join broadcasts, at most (16 bytes each as numbers); more are shuffled.
BROADCAST_ROWS = 1_000_000


def listed(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` (one column). Ids are counted first: few go to the rows, else the rows are
    shuffled to them. A null among the ids stands for rows without an id."""
    ids = ids.toDF("__listed").distinct()
    total, known = ids.agg(F.count("*"), F.count("__listed")).head()
    some = ids.where("__listed is not null")
    found = rows.join(F.broadcast(some) if known <= BROADCAST_ROWS else some, F.col(id_col) == F.col("__listed"), "left_semi")
    return found.unionByName(rows.where(F.col(id_col).isNull())) if total > known else found


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def unused(name: str, *others: str) -> str:
    """``name``, with underscores before it until none of the others begins with it, in either case."""
    taken = [o.casefold() for o in others]
    while any(o.startswith(name.casefold()) for o in taken):
        name = "_" + name
    return name


def cols(names: Iterable[str]) -> list[Column]:
    """The columns of exactly these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def with_text(docs: DataFrame, keep: Iterable[str], text_col: str) -> DataFrame:
    """The columns ``keep`` and, as the last one, the text; its name is none of theirs."""
    keep = list(keep)
    return docs.select(*cols(keep), docs[text_col].cast("string").alias(unused("__text", *keep)))


def ddl(df: DataFrame, names: Iterable[str]) -> str:
    """The named columns as the beginning of a schema text."""
    kinds = dict(df.dtypes)
    return "".join("`" + n.replace("`", "``") + f"` {kinds[n]}, " for n in names)


def text_chunks(batches: Iterable[pa.RecordBatch], column: int = -1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that no chunk of over one row has more than ``limit`` bytes in the text column, by
    default the last one (by place, as names may repeat)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column % batch.num_columns)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty texts, and the offsets of the texts (one more than texts)."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of bytes with ``is_word``, cut at the ends of texts; and
    the index of the first run of each text, with the number of runs at the end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a run that crosses the border of two texts is cut there
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the spans: differences of one running polynomial over the bytes, brought to a common power.

    ``fold`` maps bytes before hashing (lower-casing). Equal spans have equal hashes anywhere."""
    block = 1 << 18
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        values = _BYTE_VALUES[fold] if fold is not None else _BYTE_VALUES
        low, n = 0, len(starts)
        while low < n:  # in blocks of bytes, so that the running sums stay in the cache
            base = int(starts[low])
            high = max(low + 1, int(np.searchsorted(ends, base + block, side="right")))
            span = int(ends[high - 1]) - base
            power = np.full(span + 1, np.uint64(_MULTIPLIER))
            power[0] = 1
            power = np.multiply.accumulate(power)
            back = np.full(span + 1, inverse)
            back[0] = 1
            back = np.multiply.accumulate(back)
            running = np.zeros(span + 1, np.uint64)
            np.cumsum(values[data[base : base + span]] * power[:span], out=running[1:])
            s, e = starts[low:high] - base, ends[low:high] - base
            out[low:high] = mix((running[e] - running[s]) * back[s] + (e - s).astype(np.uint64))
            low = high
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words, given the words' hashes; empty with fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xA24BAED4963EE407) + mix(words[j : j + n] + np.uint64(j + 1))
    return mix(total)


def byte_class(*ranges: tuple[int, int], beyond_ascii: bool) -> np.ndarray:
    """A table over bytes: 1 for those in the ranges (ends included) and, if so told, for all beyond ASCII."""
    out = np.zeros(256, np.int8)
    for low, high in ranges:
        out[low : high + 1] = 1
    if beyond_ascii:
        out[128:] = 1
    return out


#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words cut at white space (space, and 9 to 13).
NOT_SPACE = 1 - byte_class((0x20, 0x20), (0x09, 0x0D), beyond_ascii=False)
