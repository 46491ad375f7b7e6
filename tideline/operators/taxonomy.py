"""Keyword classification: a prefilter by title and address, a final filter by title and tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import match_taxonomy, matched_keywords, sorted_ignoring_case, validate_taxonomy
from tideline.functions.urls import url_words


def _values(*maps: Column) -> Column:
    return F.flatten(F.flatten(F.array(*(F.map_values(m) for m in maps))))


def _keys(*maps: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in maps)))))


def prefilter(rows: DataFrame, taxonomy: Mapping, additions: Mapping | None = None, title_col: str = "title", url_col: str = "normalized_url", use_url: bool = True) -> DataFrame:
    """All rows with prefilter_candidate, prefilter_categories, prefilter_keywords and prefilter_reason: matches of the
    taxonomy and of the additions, in the title and in the words of the address."""
    terms = validate_taxonomy(taxonomy)
    extra = validate_taxonomy(additions) if additions else {}
    if set(extra) - set(terms):
        raise ValueError("additions name unknown categories")
    words = url_words(F.col(url_col)) if use_url else F.lit("")
    codes = ("title_taxonomy_match", "title_config_addition_match", "url_path_taxonomy_match", "url_path_config_addition_match")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:array<string>>>"))
    cols = [match_taxonomy(text, t) if t else none for text in (F.col(title_col), words) for t in (terms, extra)]
    staged = rows.withColumns({f"__m{k}": c for k, c in enumerate(cols)})
    maps = [F.col(f"__m{k}") for k in range(4)]
    reason = F.concat_ws("+", *(F.when(F.size(m) > 0, F.lit(c)) for m, c in zip(maps, codes, strict=True)))
    out = staged.withColumns({"prefilter_categories": _keys(*maps), "prefilter_keywords": sorted_ignoring_case(_values(*maps)), "prefilter_reason": F.when(reason == "", "no_title_or_url_prefilter_match").otherwise(reason)})
    return out.withColumn("prefilter_candidate", F.size("prefilter_categories") > 0).drop(*(f"__m{k}" for k in range(4)))


def candidates(rows: DataFrame) -> DataFrame:
    """The rows that the prefilter keeps."""
    return rows.where("prefilter_candidate")


def classify(rows: DataFrame, taxonomy: Mapping, priors: Sequence[str] = (), title_col: str = "title", tags: Column | None = None, section: Column | None = None) -> DataFrame:
    """All rows with is_candidate, matched_categories, matched_keywords, filter_score, filter_reason, title_matches,
    tag_matches and matched_priors. A title or tag match makes a candidate, a section prior alone doesn't. The score is
    3 for each distinct title keyword, 2 for each tag keyword, 1 for any prior."""
    terms = validate_taxonomy(taxonomy)
    tags = F.array().cast("array<string>") if tags is None else tags
    joined = F.concat_ws(" | ", tags)
    where = joined if section is None else F.concat_ws(" | ", section, tags)
    found = {"title_matches": match_taxonomy(F.col(title_col), terms), "tag_matches": match_taxonomy(joined, terms), "matched_priors": sorted_ignoring_case(matched_keywords(where, list(priors)))}
    # an array of one, exploded: no filter or projection above repeats the patterns
    staged = rows.withColumn("__f", F.explode(F.array(F.struct(*(c.alias(n) for n, c in found.items())))))
    staged = staged.withColumns({n: F.col(f"__f.{n}") for n in found}).drop("__f")
    t, p = F.col("title_matches"), F.col("tag_matches")
    count = lambda m: F.size(F.array_distinct(F.flatten(F.map_values(m))))
    prior = F.size("matched_priors") > 0
    reason = (
        F.when((F.size(t) > 0) & (F.size(p) > 0), "title_and_publisher_keyword_match").when(F.size(t) > 0, "title_keyword_match")
        .when(F.size(p) > 0, "publisher_keyword_match").when(prior, "section_prior_only_insufficient").otherwise("no_taxonomy_match")
    )
    return staged.withColumns({
        "matched_categories": _keys(t, p), "matched_keywords": sorted_ignoring_case(_values(t, p)), "filter_score": count(t) * 3 + count(p) * 2 + prior.cast("int"),
        "filter_reason": reason, "is_candidate": (F.size(t) > 0) | (F.size(p) > 0),
    })


def category_counts(rows: DataFrame, column: str = "matched_categories") -> DataFrame:
    """(category, n) over a multi-label column."""
    return rows.select(F.explode(column).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def category_dummies(rows: DataFrame, categories: Sequence[str], column: str = "matched_categories") -> DataFrame:
    """cat_x as 0 or 1 for each category x."""
    return rows.withColumns({f"cat_{c}": F.coalesce(F.array_contains(column, c), F.lit(False)).cast("int") for c in categories})
