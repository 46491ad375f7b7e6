"""Price features on a calendar, daily text aggregates, tone by lexicon."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import tokens

#: Words of a lexicon that is broadcast, at most.
LEXICON_ROWS = 1_000_000
#: Marks of a lexicon's words; a lexicon without one of them has no such words.
MARKS = ("is_positive", "is_negative", "is_uncertainty", "is_litigious", "is_constraining")
#: Two or more word characters (letters, digits, underscore), as functions.text.tokens.
TOKEN = re.compile(r"\w{2,}")


def price_features(series: DataFrame, date_col: str = "date", rate_col: str = "rate", lags: Sequence[int] = (0, 1, 2, 3, 4), momentum: Sequence[int] = (5, 20), volatility: int = 20, average: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """ret (percent), ret_lag_k, momentum_n (mean return), volatility_n (sample deviation), ma_dist_n, weekday dummies
    dow_1..dow_4, ret_next and y (1 if the next return is positive, 0 if not, null at the end). Windows need to be full.
    ``by`` names the instrument; without it the whole table is one series, hence one partition."""
    w = Window.partitionBy(*by).orderBy(date_col)

    def full(x: Column, n: int, value: Column) -> Column:
        frame = w.rowsBetween(-n + 1, 0)
        return F.when(F.count(x).over(frame) == n, value.over(frame))

    ret, rate = F.col("ret"), F.col(rate_col)
    out = series.withColumn("ret", (rate / F.lag(rate_col).over(w) - 1) * 100)
    out = out.withColumns({f"ret_lag_{k}": F.lag("ret", k).over(w) if k else ret for k in lags} | {f"momentum_{n}": full(ret, n, F.avg(ret)) for n in momentum}
                          | {f"volatility_{volatility}": full(ret, volatility, F.stddev_samp(ret)), f"ma_dist_{average}": rate / full(rate, average, F.avg(rate)) - 1, "ret_next": F.lead("ret").over(w), "row": F.row_number().over(w) - 1})
    return out.withColumns({f"dow_{k}": (F.weekday(date_col) == k).cast("int") for k in range(1, 5)} | {"y": F.when(F.col("ret_next").isNotNull(), (F.col("ret_next") > 0).cast("int"))})


def modeling_rows(features: DataFrame, warmup: int = 20) -> DataFrame:
    """Without the warm-up rows and rows that have no target."""
    return features.where((F.col("row") >= warmup) & F.col("y").isNotNull()).drop("row")


def log_volumes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p of each column, in place."""
    return rows.withColumns({c: F.log1p(c) for c in columns})


def token_rows(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, token), tokens in upper case."""
    return docs.select(key, F.posexplode(tokens(text)).alias("pos", "token")).withColumn("token", F.upper("token"))


def _counted(docs: DataFrame, words: dict[str, tuple[bool, ...]], key: str, text: Column, negators: frozenset[str], reach: int) -> DataFrame:
    """(key, n_tokens, pos, neg, unc, lit, con) of each row, counted inside the row: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # LEXICON_ROWS at most
    kind, names = dict(docs.dtypes)[key], ["n_tokens", "pos", "neg", "unc", "lit", "con"]

    def run(batches):
        known = shared.value
        for batch in batches:
            sums = []
            for value in batch.column(1).to_pylist():
                found = [t.upper() for t in TOKEN.findall(value or "")]
                pos = neg = unc = lit = con = 0
                for i, word in enumerate(found):
                    marks = known.get(word)
                    if marks:
                        p, n, u, law, bound = marks
                        if p and negators.isdisjoint(found[max(0, i - reach) : i]):
                            pos += 1
                        elif p or n:
                            neg += 1
                        unc += u
                        lit += law
                        con += bound
                sums.append((len(found), pos, neg, unc, lit, con))
            counts = [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] if sums else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], names=["k", *names])

    return docs.select(F.col(key).alias("k"), text.alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("k", key)


def _joined(docs: DataFrame, lexicon: DataFrame, key: str, text: Column, negators: Sequence[str], reach: int) -> DataFrame:
    """As _counted, for a lexicon too large to go to all executors: words of it meet the texts' words in a join."""
    words = docs.select(F.col(key), F.monotonically_increasing_id().alias("__id"), F.transform(tokens(text), lambda t: F.upper(t)).alias("__t"))
    flagged = F.transform("__t", lambda t, i: F.struct(t.alias("w"), F.exists(F.slice(F.col("__t"), F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach))), lambda p: p.isin(*negators)).alias("neg")))
    hit = words.select(key, "__id", F.size("__t").cast("long").alias("__n"), F.explode_outer(flagged).alias("x")).join(lexicon, F.col("x.w") == F.col("word"), "left")
    p, n, u, law, bound = (F.coalesce(F.col(c), F.lit(False)) for c in MARKS)
    negated = F.col("x.neg")
    counts = {"pos": p & ~negated, "neg": (p & negated) | (~p & n), "unc": u, "lit": law, "con": bound}
    return hit.groupBy("__id", key).agg(F.max("__n").alias("n_tokens"), *(F.count_if(c).alias(k) for k, c in counts.items())).drop("__id")


def tone(docs: DataFrame, lexicon: DataFrame, key: str, text: Column, negators: Sequence[str] = ("NO", "NOT", "NEVER", "NONE", "WITHOUT"), reach: int = 3) -> DataFrame:
    """Per row n_tokens, lm_neg, lm_pos, lm_unc (shares of tokens), lm_net = (pos-neg)/(pos+neg+1), lm_has_hit (of these
    three kinds), and the counts litigious and constraining.

    ``lexicon``: word and those of MARKS that it has. A positive word counts as negative if a negator stands
    among the ``reach`` tokens before it; a word in both lists is positive; negated negatives stay negative. Texts
    without tokens have zeros; a word that the lexicon repeats has the marks of all its rows."""
    mark = lambda c: F.max(F.coalesce(F.col(c), F.lit(False))) if c in lexicon.columns else F.lit(False)
    lexicon = lexicon.where("word is not null").groupBy("word").agg(*(mark(c).alias(c) for c in MARKS))
    if lexicon.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS:
        sums = _counted(docs, {r[0]: tuple(r)[1:] for r in lexicon.collect()}, key, text, frozenset(negators), reach)
    else:
        sums = _joined(docs, lexicon, key, text, negators, reach)
    share = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return sums.select(
        key, "n_tokens", share("neg").alias("lm_neg"), share("pos").alias("lm_pos"), share("unc").alias("lm_unc"),
        ((F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1)).alias("lm_net"), ((F.col("pos") + F.col("neg") + F.col("unc")) > 0).alias("lm_has_hit"),
        F.col("lit").alias("litigious"), F.col("con").alias("constraining"),
    )


def daily(rows: DataFrame, calendar: DataFrame, key: str, date_col: str, categories: Sequence[str] = (), measures: Sequence[str] = (), category_col: str = "matched_categories") -> DataFrame:
    """For each calendar date the count of rows, of rows per category, the mean of each measure, and its mean per
    category (one pass, filtered aggregates); 0 where there are none. Rows without a date drop out."""
    member = {c: F.coalesce(F.array_contains(category_col, c), F.lit(False)) for c in categories}
    aggs = [F.count(key).alias("news_count"), *(F.count_if(m).alias(f"count_{c}") for c, m in member.items()), *(F.avg(m).alias(f"mean_{m}") for m in measures)]
    aggs += [F.avg(F.when(on, F.col(m))).alias(f"mean_{m}_{c}") for c, on in member.items() for m in measures]
    sums = rows.where(F.col(date_col).isNotNull()).groupBy(F.col(date_col).alias("__d")).agg(*aggs)
    out = calendar.join(sums, calendar["date"] == sums["__d"], "left").drop("__d")
    return out.na.fill(0, [c for c in sums.columns if c != "__d"])


def reconcile(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """One row: matched keys, keys on one side only, and per column the matched rows that differ."""
    a, b = left.select(on, *columns).alias("a"), right.select(on, *columns).alias("b")
    both = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"), "full")
    has_a, has_b = F.col(f"a.{on}").isNotNull(), F.col(f"b.{on}").isNotNull()
    return both.agg(F.count_if(has_a & has_b).alias("matched"), F.count_if(has_a & ~has_b).alias("left_only"), F.count_if(~has_a & has_b).alias("right_only"),
                    *(F.count_if(has_a & has_b & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"differ_{c}") for c in columns))


def modeling_table(prices: DataFrame, text: DataFrame, date_col: str = "date", suffix: str = "_nlp") -> DataFrame:
    """Price rows with the text features of their date (0 without any). Columns that both have keep the price side's
    name, the text side's gets the suffix. Null features of rows past the warm-up are an error of the caller's windows,
    which splits.leakage_checks tells."""
    named = text.select(F.col(date_col).alias("__d"), *(F.col(c).alias(c + suffix if c in prices.columns else c) for c in text.columns if c != date_col))
    added = [c for c in named.columns if c != "__d"]
    return prices.join(named, prices[date_col] == named["__d"], "left").drop("__d").na.fill(0, added)


def article_features(rows: DataFrame, lexicon: DataFrame, key: str, title_col: str, prefixes: Sequence[str] = (), negators: Sequence[str] = ("NO", "NOT", "NEVER", "NONE", "WITHOUT")) -> DataFrame:
    """Rows with normalized_title (clean, prefixes stripped; empty rather than null) and the tone of it."""
    from tideline.functions.text import clean_title, strip_prefixes

    titled = rows.withColumn("normalized_title", strip_prefixes(clean_title(F.col(title_col)), prefixes))
    return titled.join(tone(titled, lexicon, key, F.col("normalized_title"), negators), key, "left")
