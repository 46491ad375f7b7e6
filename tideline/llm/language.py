"""Language identification by Bayesian fusion of evidence.

Byte trigrams, counted in texts of known language, give each page a likelihood by language. What the markup declares and
how the address ends are further evidence, whose likelihoods by language are estimated from the corpus itself by grouped
aggregation of the text posteriors. The prior is hierarchical: a host's languages, smoothed towards those of its domain,
which are smoothed towards those of all pages; a page's own text never enters its own prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table, text_chunks, utf8, written
from .sampling import texts_of, thinned

#: Training texts of each language, about.
FIT_ROWS = 1500
_BITS = 16
#: Pseudo-counts with which a host is drawn to its domain, a domain to all pages, and evidence to independence.
HOST_PULL, DOMAIN_PULL, EVIDENCE_PULL = 5.0, 5.0, 20.0
#: Trigrams are far from independent: their joint log-likelihood is that of this many, at most.
EFFECTIVE = 200.0

_CLOSING = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_OPENING = re.compile(rb"(?i)<(script|style)\b")


def visible(html: bytes) -> bytes:
    """The text of a page: without tags, scripts, styles and comments, each of which leaves a space. One scan forward: what
    is never closed is looked for once, and then counts as a tag, or as text if that isn't closed either."""
    out, at, missing = [], 0, set()

    def closing(name: bytes, begin: int) -> int:
        if name in missing:
            return -1
        if name in _CLOSING:
            found = _CLOSING[name].search(html, begin)
            end = found.end() if found else -1
        else:
            end = html.find(name, begin)
            end = end + len(name) if end >= 0 else -1
        if end < 0:
            missing.add(name)
        return end

    while True:
        begin = html.find(b"<", at)
        if begin < 0:
            break
        out.append(html[at:begin])
        opened = _OPENING.match(html, begin)
        end = closing(opened[1].lower(), begin) if opened else closing(b"-->", begin + 4) if html.startswith(b"<!--", begin) else -1
        if end < 0:
            end = closing(b">", begin)
        if end < 0:
            at = begin
            break
        out.append(b" ")
        at = end
    out.append(html[at:])
    return b"".join(out)


def _codes(data: np.ndarray) -> np.ndarray:
    """A hash of each byte trigram, A-Z as a-z."""
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - _BITS)).astype(np.int64)


class TextModel:
    """Log-probabilities of hashed trigrams by language; its size depends on the number of languages only."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        counts = np.stack([np.bincount(np.concatenate([_codes(np.frombuffer(t, np.uint8)) for t in texts[k]] or [np.zeros(0, np.int64)]), minlength=1 << _BITS) for k in self.languages]) if texts else np.zeros((0, 1 << _BITS))
        total = counts.sum(0) + 1.0
        smooth = counts + 50.0 * total / total.sum()
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the tempered log-likelihood by language, its largest being 0."""
        out = np.zeros((len(texts), len(self.languages)))
        for row, text in zip(out, texts, strict=True):
            codes = _codes(np.frombuffer(text, np.uint8))
            if len(codes) and len(self.languages):
                row[:] = self.logs[:, codes].mean(1, dtype=np.float64) * min(len(codes), EFFECTIVE)
        return out - out.max(1, keepdims=True, initial=0 if not len(self.languages) else -np.inf) if len(self.languages) else out


def fit(docs: DataFrame, lang_col: str = "lang", doc_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, most_languages: int = 200) -> TextModel:
    """A model of the ``most_languages`` most frequent languages, from about ``rows`` texts of each (documented bounds;
    picked by the hash of the id). Null languages teach nothing."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(doc_col).isNotNull())
    names = [r[0] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()]
    texts = {}
    for name in names:
        ids = thinned(known.where(F.col(lang_col) == name).select(F.col(doc_col).alias("doc_id")), "doc_id", rows).distinct()
        texts[str(name)] = [r.text.encode() for r in texts_of(known.where(F.col(lang_col) == name), ids, doc_col, text_col).orderBy("doc_id").collect()]
    return TextModel(texts)


def evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, text array<double> (log-likelihoods), declared, suffix, host, domain of each page; no markup is carried on."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    url = F.lower(F.coalesce(pages[url_col].cast("string"), F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    segment = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    picked = pages.select(
        pages[id_col].alias("id"), declared.alias("declared"), F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), segment).alias("suffix"), host.alias("host"),
        F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"), html.alias("__html"),
    )
    kind = dict(picked.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = utf8(chunk.column(chunk.num_columns - 1))
            raw = data.tobytes()
            logs = shared.value.likelihoods([visible(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * logs.shape[1], pa.int32()), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], lists], names=["id", "declared", "suffix", "host", "domain", "text"])

    return picked.mapInArrow(run, f"id {kind}, declared string, suffix string, host string, domain string, text array<double>")


def _softmax(logs: Column, n: int) -> Column:
    parts = [F.exp(logs[k] - F.array_max(logs)) for k in range(n)]
    total = sum(parts[1:], parts[0])
    return F.array(*(p / total for p in parts))


def _sums(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """By key the summed text posteriors: a few doubles, pre-aggregated, so that a hot key costs nothing."""
    return rows.groupBy(key).agg(*(F.sum(F.col("post")[k]).alias(f"{name}{k}") for k in range(n)))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The language of each page: id, lang, score (its posterior, double), text_lang (by the text alone), declared.

    Every row gives one row. Null or empty pages and addresses carry no evidence of that kind (an empty text is equally
    likely in all languages); ties go to the language that is first in order. Without any known language lang and score
    are null."""
    names = model.languages
    n = len(names)
    rows = evidence(pages, model, id_col, url_col, html_col)
    if not n:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text_lang"), "declared")
    rows = written(rows.withColumn("post", _softmax(F.col("text"), n)), "evidence")
    total = rows.agg(*(F.sum(F.col("post")[k]) for k in range(n))).head()
    sizes = [(x or 0.0) + 1.0 for x in total]
    share = [x / sum(sizes) for x in sizes]
    found = rows
    for key, name in (("declared", "__d"), ("suffix", "__s"), ("domain", "__m"), ("host", "__h")):
        # a table, so that Spark broadcasts it if it is small, and else has a plain shuffle on either side and can split a hot key
        found = found.join(written(_sums(rows, key, name, n), "sums"), key)
    logs = []
    own = [F.col("post")[k] for k in range(n)]
    left = lambda name: [F.greatest(F.col(f"{name}{k}") - own[k], F.lit(0.0)) for k in range(n)]  # noqa: E731  without the page itself
    domain, host, declared, suffix = left("__m"), left("__h"), left("__d"), left("__s")
    plus = lambda cols: sum(cols[1:], cols[0])
    for k in range(n):
        by_domain = (domain[k] + DOMAIN_PULL * share[k]) / (plus(domain) + DOMAIN_PULL)
        by_host = (host[k] + HOST_PULL * by_domain) / (plus(host) + HOST_PULL)
        log = F.col("text")[k] + F.log(by_host)
        for col, seen in (("declared", declared), ("suffix", suffix)):
            ratio = (seen[k] + EVIDENCE_PULL * share[k]) / ((plus(seen) + EVIDENCE_PULL) * share[k])
            log = log + F.when(F.col(col) == "", 0.0).otherwise(F.log(ratio))
        logs.append(log)
    listed = F.array(*(F.lit(x) for x in names))
    best = lambda xs: F.element_at(listed, F.array_position(xs, F.array_max(xs)).cast("int"))
    fused = found.select("id", "declared", "text", F.array(*logs).alias("logs"))
    done = fused.select("id", "declared", "text", "logs", _softmax(F.col("logs"), n).alias("p"))
    return done.select("id", best(F.col("logs")).alias("lang"), F.array_max("p").alias("score"), best(F.col("text")).alias("text_lang"), "declared")


def op4_bayesian_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page: page_id, lang, score, text_lang, declared."""
    return identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "page_id")
