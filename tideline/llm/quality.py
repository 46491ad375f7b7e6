"""A quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed with either, in blocks,
so that a long text is judged in all its parts; the difference of the compressed sizes, normalised by the length, goes
with the sizes themselves into a logistic calibration, fitted on labelled texts that the dictionaries haven't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cols, ddl, held_out, table, text_chunks, unused, utf8, with_text
from .sampling import labelled

#: Labelled texts of each class in the fit, about; half make the dictionary, half the calibration.
FIT_ROWS = 3000
DICTIONARY_BYTES = 110_000
BLOCK = 4096
LEVEL = 3
THRESHOLD = 0.3


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES: trained, or of pieces of all samples where they are too few to train on."""
    parts = [x[i : i + 2048] for x in samples for i in range(0, len(x), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        stride = max(1, -(-sum(map(len, parts)) // DICTIONARY_BYTES))
        return b"".join(parts[::stride])[:DICTIONARY_BYTES]


class CompressionModel:
    """Dictionaries and calibration; small, of a size that doesn't depend on the data."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.constant = None if good and bad else (1.0 if good else 0.0 if bad else 0.5)
        if self.constant is not None:
            return
        self.dictionaries = [dictionary(good[::2]), dictionary(bad[::2])]
        held = [*(good[1::2] or good), *(bad[1::2] or bad)]
        y = np.repeat([1.0, 0.0], [len(good[1::2] or good), len(bad[1::2] or bad)])
        x = self._expand(self.sizes(held))
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.spread]
        w, ridge = np.zeros(a.shape[1]), 0.1
        for _ in range(30):  # Newton steps of a ridge-penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        self.weights = w

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            made = zstandard.ZstdCompressionDict(raw)
            made.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: bytes, and bytes after compression with either dictionary."""
        good, bad = (c.compress for c in self._compressors())
        out = np.zeros((len(texts), 3))
        for row, text in zip(out, texts, strict=True):
            row[0] = len(text)
            for i in range(0, max(1, len(text)), BLOCK):
                block = text[i : i + BLOCK]
                row[1] += len(good(block))
                row[2] += len(bad(block))
        return out

    @staticmethod
    def _expand(sizes: np.ndarray) -> np.ndarray:
        n = sizes[:, 0] + 20
        x = np.stack([(sizes[:, 1] - sizes[:, 2]) / n, sizes[:, 1] / n, sizes[:, 2] / n, np.log(n)], 1)
        return np.concatenate([x, *(x[:, [i]] * x[:, i:] for i in range(4))], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1, higher for good texts."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        x = (self._expand(self.sizes(texts)) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> CompressionModel:
    """A model of about ``rows`` texts of each label (a sample by the hash of the id; a documented bound). ``labels``
    should hold only what may be learned from. With labels of one kind only, or none, scores are constant."""
    found = []
    for value in (1, 0):
        got = labelled(docs, labels, label, value, rows, doc_col, text_col).collect()
        found.append([r.text.encode() for r in sorted(got, key=lambda r: zlib.crc32(f"fit {r.doc_id}".encode()))])
    return CompressionModel(*found)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score (double) of each row's whole text; nulls and empty texts score as the empty
    text. One row out for each row in, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = with_text(docs, keep, text_col)
    kinds = ddl(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = utf8(chunk.column(chunk.num_columns - 1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())], names=[*keep, name])

    return picked.mapInArrow(run, f"{kinds}`{name}` double")


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; columns as they are."""
    names = docs.columns
    own = unused("__quality", *names)
    return score(docs, model, text_col, tuple(names), own).where(F.col(own) >= threshold).select(*cols(names))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows whose labels may be learned from."""
    return labels.where(~held_out("doc_id", 5, 0))


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    found = score(docs, model, keep=("doc_id",))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
