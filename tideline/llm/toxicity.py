"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words and word beginnings is trained in numpy from confirmed toxic texts and from
unlabelled ones. The risk of the negative class isn't seen; it is the risk over unlabelled texts less the share that the
positives have in it (the class prior). Where that estimate falls below zero, which only overfitting can bring about,
the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_class, ddl, held_out, mix, table, text_chunks, utf8, with_text, word_hashes, word_spans
from .sampling import FIT_BYTES, labelled, texts_of, thinned

#: Confirmed toxic texts and unlabelled texts in the fit, about.
FIT_POSITIVE, FIT_UNLABELLED = 3000, 12_000
FEATURES = 512
THRESHOLD = 0.7
_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), beyond_ascii=True)
_TABLE_BITS = 22


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each feature occurrence: every word (letters A-Z as a-z) and its beginnings of 4 and 5
    bytes."""
    starts, ends, first = word_spans(data, offsets, _WORD)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    texts, hashes = [owner], [word_hashes(data, starts, ends, LOWER)]
    for size in (4, 5):
        long = ends - starts >= size
        texts.append(owner[long])
        with np.errstate(over="ignore"):
            hashes.append(mix(word_hashes(data, starts[long], starts[long] + size, LOWER) + np.uint64(size)))
    return np.concatenate(texts), np.concatenate(hashes)


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk with logistic loss, and their gradients: that of positives, prior times their mean loss as
    positives; and that of negatives, the mean loss of unlabelled texts as negatives less prior times that of positives,
    which the estimator holds at zero or above. ``theta`` has the weights and then the bias."""
    gp, gu = (x @ theta[:-1].astype(x.dtype) + theta[-1] for x in (xp, xu))
    sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
    grad = lambda x, d: np.append(d.astype(x.dtype) @ x, d.sum()) / len(d)
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    return prior * np.logaddexp(0, -gp).mean(), negative, prior * grad(xp, sp - 1), grad(xu, su) - prior * grad(xp, sp)


class PuModel:
    """Hashes of the chosen features, their weights, and the bias."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7):
        """The lists hold the distinct feature hashes of each text; ``prior`` is the share of positives among all."""
        self.hashes, self.weights, self.bias = np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        if not positive or not unlabelled:
            return
        prior = min(max(prior, 1e-4), 0.9)
        seen, inverse = np.unique(np.concatenate(positive), return_inverse=True)
        in_p = np.bincount(inverse)
        often = in_p >= max(2, 0.003 * len(positive))
        seen, in_p = seen[often], in_p[often]
        if not len(seen):
            return
        u = np.concatenate(unlabelled)
        at = np.minimum(np.searchsorted(seen, u), len(seen) - 1)
        in_u = np.bincount(at[seen[at] == u], minlength=len(seen))
        rate_p, rate_u = in_p / len(positive), (in_u + 0.5) / len(unlabelled)
        lift = rate_p / rate_u
        good = np.flatnonzero((lift >= min(3.0, 0.5 / prior)) & (in_p * np.log(lift) >= 5))  # more than chance
        best = good[np.argsort(-(rate_p * np.log(lift))[good], kind="stable")[:FEATURES]]
        self.hashes = np.sort(seen[best])
        if not len(best):
            return
        xp, xu = self._matrix(positive), self._matrix(unlabelled)
        self.weights = np.zeros(len(self.hashes))
        self._train(xp, xu, prior)

    def _matrix(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.hashes)), np.float32)
        for k, row in enumerate(rows):
            at = np.minimum(np.searchsorted(self.hashes, row), len(self.hashes) - 1)
            out[k, at[self.hashes[at] == row]] = 1
        return out

    def _train(self, xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 250, rate: float = 0.08, decay: float = 2e-4) -> None:
        theta = np.append(self.weights, self.bias)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            _, negative, of_positive, of_negative = risk(theta, xp, xu, prior)
            step = of_positive + of_negative if negative >= 0 else -of_negative
            step[:-1] += decay * theta[:-1]
            m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.bias = theta[:-1], float(theta[-1])

    def prepared(self) -> PuModel:
        """With a table over the low bits of the hashes, for quick rejection."""
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher for toxic texts."""
        texts, hashes = features(data, offsets)
        maybe = self.table[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]
        texts, hashes = texts[maybe], hashes[maybe]
        total = np.full(len(offsets) - 1, self.bias)
        if len(hashes) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(texts[hit] * len(self.hashes) + at[hit])
            total += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _feature_sets(rows: DataFrame) -> list[np.ndarray]:
    """Of each text (a bounded sample): its distinct feature hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts, hashes = features(*utf8(chunk.column(0)))
            order = np.argsort(texts, kind="stable")
            cut = np.searchsorted(texts[order], np.arange(1, chunk.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(x).tobytes() for x in np.split(hashes[order], cut)], pa.binary())], names=["f"])

    return [np.frombuffer(r.f, np.uint64) for r in rows.select("text").mapInArrow(run, "f binary").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_col: str = "doc_id", text_col: str = "text", unlabelled: DataFrame | None = None, prior: float | None = None, positive_rows: int = FIT_POSITIVE, unlabelled_rows: int = FIT_UNLABELLED) -> PuModel:
    """A model from about ``positive_rows`` texts with label 1 and ``unlabelled_rows`` others (documented bounds; picked
    by the hash of the id). ``prior`` is the share of toxic texts, by default that among ``labels``, which should hold
    only what may be learned from; 0.05 where there are none."""
    if prior is None:
        row = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).head()
        prior = 0.05 if row[0] is None else row[0]
    positive = _feature_sets(labelled(docs, labels, label, 1, positive_rows, doc_col, text_col))
    ids = (docs if unlabelled is None else unlabelled).where(F.octet_length(F.col(text_col)) <= FIT_BYTES).select(F.col(doc_col).alias("doc_id")).where("doc_id is not null")
    return PuModel(positive, _feature_sets(texts_of(docs, thinned(ids, "doc_id", unlabelled_rows).distinct(), doc_col, text_col)), prior)


def score(docs: DataFrame, model: PuModel, text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score (double) of each row's whole text; nulls count as the empty text, which has
    the score of a text without any toxic sign. One row out for each row in, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    picked = with_text(docs, keep, text_col)
    kinds = ddl(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value.prepared()
        for chunk in text_chunks(batches):
            values = ready.scores(*utf8(chunk.column(chunk.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(values, pa.float64())], names=[*keep, name])

    return picked.mapInArrow(run, f"{kinds}`{name}` double")


def op3_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    found = score(docs, model, keep=("doc_id",))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
