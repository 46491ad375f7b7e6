"""Tone by lexicon, filtered means, correlation, TF-IDF and components over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import features, models, stats

from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: An invented lexicon over frequent tokens: (word, positive, negative, uncertainty, litigious, constraining).
LEXICON = [
    ("THE", True, False, False, False, True), ("AND", True, True, False, True, False), ("OF", False, True, False, False, False), ("DE", False, True, True, True, True),
    ("ER", True, False, True, False, False), ("ION", False, False, True, False, False), ("WITH", False, False, False, True, False),
]
NEGATORS = ("IN", "LA", "TO")
_LEX = ", ".join(str(row) for row in LEXICON)
TONE = f"""lex(word, p, n, u, law, bound) AS (VALUES {_LEX}), d AS (SELECT doc_id, lang, source, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: upper(x)) AS t FROM documents),
e AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM d),
g AS (SELECT doc_id, w, coalesce(max(CAST(w IN {NEGATORS} AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS neg FROM e),
h AS (SELECT doc_id, count(*) FILTER (p AND NOT neg) AS pos, count(*) FILTER ((p AND neg) OR (NOT p AND n)) AS ng, count(*) FILTER (u) AS un, count(*) FILTER (law) AS lit, count(*) FILTER (bound) AS con FROM g JOIN lex ON lex.word = g.w GROUP BY doc_id),
tone AS (SELECT d.doc_id, lang, source, CAST(len(t) AS BIGINT) AS n_tokens, coalesce(pos, 0) AS pos, coalesce(ng, 0) AS ng, coalesce(un, 0) AS un, coalesce(lit, 0) AS litigious, coalesce(con, 0) AS constraining FROM d LEFT JOIN h USING (doc_id)),
s AS (SELECT doc_id, lang, source, n_tokens, CASE WHEN n_tokens > 0 THEN ng / n_tokens ELSE 0 END AS lm_neg, CASE WHEN n_tokens > 0 THEN pos / n_tokens ELSE 0 END AS lm_pos,
 CASE WHEN n_tokens > 0 THEN un / n_tokens ELSE 0 END AS lm_unc, (pos - ng) / (pos + ng + 1) AS lm_net, pos + ng + un > 0 AS lm_has_hit, litigious, constraining FROM tone)"""


def toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of each document, with its language and source."""
    docs = table(spark, sf_dir, "documents")
    lexicon = spark.createDataFrame(LEXICON, "word string, " + ", ".join(f"{m} boolean" for m in features.MARKS))
    return features.tone(docs, lexicon, "doc_id", F.col("text"), NEGATORS).join(docs.select("doc_id", "lang", "source"), "doc_id")


@R.query(f"WITH {TONE} SELECT doc_id, n_tokens, round(lm_neg, 6) AS lm_neg, round(lm_pos, 6) AS lm_pos, round(lm_unc, 6) AS lm_unc, round(lm_net, 6) AS lm_net, lm_has_hit, litigious, constraining FROM s")
def lexicon_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone with negation of each document."""
    return rounded(toned(spark, sf_dir).drop("lang", "source"))


@R.query(f"WITH {TONE} SELECT lang, count(*) AS n, round(avg(lm_net), 6) AS mean_net, round(avg(lm_net) FILTER (source IN ('src1', 'src2')), 6) AS mean_net_some, round(avg(lm_neg) FILTER (lm_has_hit), 6) AS mean_neg_hit FROM s GROUP BY lang")
def tone_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and filtered means of tone per language, in one pass."""
    rows = toned(spark, sf_dir)
    return rounded(rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("lm_net").alias("mean_net"), F.avg(F.when(F.col("source").isin("src1", "src2"), F.col("lm_net"))).alias("mean_net_some"), F.avg(F.when(F.col("lm_has_hit"), F.col("lm_neg"))).alias("mean_neg_hit")))


@R.query(f"WITH {TONE} SELECT round(corr(lm_net, CAST(lang = 'en' AS INT)), 6) AS corr_en, round(corr(lm_net, CAST(lang = 'de' AS INT)), 6) AS corr_de FROM s")
def tone_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of tone with language flags."""
    rows = toned(spark, sf_dir).withColumns({c: (F.col("lang") == c).cast("int") for c in ("en", "de")})
    return rounded(stats.correlation(rows, "lm_net", ["en", "de"]))


STOP = ("the", "of", "and", "la", "de")
_WORDS = "list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}'), lambda x: lower(x)), lambda x: x NOT IN " + str(STOP) + ")"
VOCAB = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), nd AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1),
top AS (SELECT term, df FROM df WHERE df >= 3 AND df <= 0.8 * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT 300),
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1.0 + (SELECT n FROM nd)) / (1 + df)) + 1 AS idf FROM top)"""


def vocab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Terms of the documents, and a vocabulary of 300 (the feature's own cap)."""
    docs = table(spark, sf_dir, "documents")
    found = models.terms(docs, "doc_id", F.col("text"), STOP)
    return found, models.vocabulary(found, docs.count(), min_df=3, max_df=0.8, max_features=300)


@R.query(f"WITH {VOCAB} SELECT term, CAST(idx AS INT) AS idx, round(idf, 6) AS idf FROM v")
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary with inverse document frequencies."""
    return rounded(vocab(spark, sf_dir)[1])


@R.query(f"WITH {VOCAB}, r AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN v USING (term)) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM r")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights, documents of unit length."""
    found, v = vocab(spark, sf_dir)
    return rounded(models.tfidf(found, v, "doc_id").select("doc_id", "term", "weight"))


@R.query()
def svd_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top terms of five components."""
    found, v = vocab(spark, sf_dir)
    v = v.persist()
    components, _ = models.truncated_svd(models.tfidf(found, v, "doc_id"), "doc_id", 5, v.count())
    return rounded(models.top_terms(components, v, 5))


@R.query()
def svd_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance of five components."""
    found, v = vocab(spark, sf_dir)
    v = v.persist()
    weights = models.tfidf(found, v, "doc_id").persist()
    _, rows = models.truncated_svd(weights, "doc_id", 5, v.count())
    return rounded(spark.createDataFrame(list(enumerate(models.explained_variance(rows, weights, "doc_id", 5))), "component int, explained double"))


@R.query()
def svd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean components per language."""
    found, v = vocab(spark, sf_dir)
    v = v.persist()
    _, rows = models.truncated_svd(models.tfidf(found, v, "doc_id"), "doc_id", 5, v.count())
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return rounded(rows.join(langs, "doc_id").groupBy("lang").agg(*(F.avg(F.col("svd")[j]).alias(f"svd_{j}") for j in range(5))))


