"""Column functions over titles, keywords and tokens. All but NFC run inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character: letters and digits of any script, and the underscore. Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no function for it; plain ASCII never reaches Python's normaliser's slow path."""
    return _nfc(text)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space (Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_title(text: Column) -> Column:
    """NFC with white space collapsed; null becomes the empty text."""
    return F.coalesce(collapse_spaces(nfc(text)), F.lit(""))


def strip_prefixes(text: Column, prefixes: Sequence[str]) -> Column:
    """Without any of the prefixes, however often they repeat; case doesn't matter, longer ones go first."""
    parts = "|".join(re.escape(p.strip()) for p in sorted(set(prefixes), key=lambda p: (-len(p), p)) if p.strip())
    return F.trim(F.regexp_replace(text, rf"(?iu)^(?:\s*(?:{parts}))+", "")) if parts else F.trim(text)


def tokens(text: Column, least: int = 2) -> Column:
    """Maximal runs of ``least`` or more word characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WORD}{{{least},}}"), F.lit(0))


def keyword_pattern(keyword: str) -> str:
    """A pattern for the phrase between word boundaries, in any case, any white space between its words."""
    if not keyword.strip():
        raise ValueError("a keyword must not be empty")
    body = r"\s+".join(re.escape(w) for w in keyword.split())
    return rf"(?iu)(?<!{WORD}){body}(?!{WORD})"


def has_keyword(text: Column, keyword: str) -> Column:
    """Whether the phrase occurs; null counts as the empty text."""
    return F.coalesce(text, F.lit("")).rlike(keyword_pattern(keyword))


def validate_taxonomy(taxonomy: Mapping) -> dict[str, list[str]]:
    """The keywords by category; raises ValueError for empty or malformed definitions."""
    if not isinstance(taxonomy, Mapping) or not taxonomy:
        raise ValueError("the taxonomy must be a non-empty mapping")
    found = {}
    for category, spec in taxonomy.items():
        words = spec.get("keywords") if isinstance(spec, Mapping) else spec
        if not isinstance(category, str) or not category.strip() or isinstance(words, str) or not isinstance(words, Sequence) or not words:
            raise ValueError(f"category {category!r} needs a list of keywords")
        if any(not isinstance(w, str) or not w.strip() for w in words):
            raise ValueError(f"category {category!r} has an empty keyword")
        found[category] = list(words)
    return found


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords that occur, in the given order. One projection: patterns compile once per task."""
    return F.array_compact(F.array(*(F.when(has_keyword(text, k), F.lit(k)) for k in keywords))) if keywords else F.array().cast("array<string>")


def match_taxonomy(text: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """Map from category to its matched keywords; categories without a match are left out."""
    entries = F.array(*(F.struct(F.lit(c).alias("key"), matched_keywords(text, ks).alias("value")) for c, ks in taxonomy.items()))
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def sorted_ignoring_case(values: Column) -> Column:
    """Distinct values by their lower-case form, then by themselves."""

    def order(a: Column, b: Column) -> Column:
        x, y = F.lower(a), F.lower(b)
        return F.when(x < y, -1).when(x > y, 1).when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.array_sort(F.array_distinct(values), order)


def decode_list(text: Column, bad: str = "value") -> Column:
    """A JSON array of texts; anything else gives [text] with ``bad`` = "value", [] with "empty". Null and "" give []."""
    parsed = F.from_json(text, "array<string>")
    other = F.array(text) if bad == "value" else F.array().cast("array<string>")
    looks = F.trim(text).rlike(r"(?s)^\[.*\]$")
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).when(looks & parsed.isNotNull(), parsed).otherwise(other)


def flags(*pairs: tuple[str, Column]) -> Column:
    """Sorted array of the codes whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in pairs))))
