"""Column functions over dates, timestamps, rates and intervals."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_date(text: Column) -> Column:
    """A date from full YYYY-M-D or M/D/YYYY, a time of day after it being cut off; null for serial numbers, partial
    dates, day-first dates and anything with a zone. An apostrophe before it is ignored."""
    halves = F.split(F.ltrim(F.trim(text), F.lit("'")), "[ T]", 2)
    day, clock = halves[0], F.try_element_at(halves, F.lit(2))
    parts = F.split(day, "[-/]")
    iso, american = day.rlike("^[0-9]+-[0-9]+-[0-9]+$"), day.rlike("^[0-9]+/[0-9]+/[0-9]+$")
    place = lambda first, other: F.when(iso, F.try_element_at(parts, F.lit(first))).when(american, F.try_element_at(parts, F.lit(other)))
    y, m, d = place(1, 3), place(2, 1), place(3, 2)
    timed = clock.isNull() | clock.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$")
    sized = (F.length(y) == 4) & (F.length(m) <= 2) & (F.length(d) <= 2)
    return F.when(timed & sized, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))


def parse_rate(text: Column) -> Column:
    """A positive rate: currency marks and apostrophes go; groups of three digits may be parted by white space, dots or
    commas, decimals (two at most beside groups) by the other mark. Null where that is ambiguous or not positive.

    The last mark is looked at first: three digits after it make it a mark of groups, one or two a decimal mark."""
    bare = F.regexp_replace(F.ltrim(F.trim(text), F.lit("'")), r"(?i)^(?:Rp\.?|IDR)\s*", "")
    chunks = F.split(bare, r"\s+")
    whole = F.transform(chunks, lambda c: F.regexp_replace(c, "^[+-]", ""))
    later = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
    of_three = lambda c: F.split(c, "[.,]")[0].rlike("^[0-9]{3}$")
    spaced = F.element_at(whole, 1).rlike("^[0-9]{1,3}$") & F.forall(later, of_three) & F.forall(F.slice(whole, F.lit(1), F.size(whole) - 1), lambda c: ~c.rlike("[.,]")) & F.element_at(chunks, -1).rlike("^[0-9]+([.,][0-9]{1,2})?$")
    number = F.array_join(chunks, "")
    marks, groups = F.regexp_extract_all(number, F.lit("[.,]"), F.lit(0)), F.split(F.regexp_replace(number, "^[+-]", ""), "[.,]")
    n, last, tail = F.size(marks), F.try_element_at(marks, F.lit(-1)), F.element_at(groups, -1)
    inner = F.slice(groups, F.lit(2), F.greatest(n - 1, F.lit(0)))
    headed = F.element_at(groups, 1).rlike("^[0-9]{1,3}$") & F.forall(inner, lambda g: g.rlike("^[0-9]{3}$"))
    kinds = F.size(F.array_distinct(marks))
    before = F.slice(marks, F.lit(1), F.greatest(n - 1, F.lit(0)))
    in_groups = (n > 0) & headed & tail.rlike("^[0-9]{3}$")
    decimal = tail.rlike("^[0-9]{1,2}$") & F.when(n == 1, (last == ",") & F.element_at(groups, 1).rlike("^[0-9]+$")).otherwise(headed & (F.size(F.array_distinct(before)) == 1) & ~F.array_contains(before, last))
    digits = F.regexp_replace(number, "[.,]", "")
    plain = F.when(number.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    read = F.when(in_groups, F.when(kinds == 1, digits.try_cast("double"))).when(decimal, F.concat_ws(".", F.left(digits, F.length(digits) - F.length(tail)), tail).try_cast("double")).otherwise(plain)
    value = F.when((F.size(chunks) == 1) | spaced, read)
    return F.when((value > 0) & (value < float("inf")), value)


def parse_aware(text: Column) -> Column:
    """A timestamp from text that names its offset; naive times are never guessed to be UTC, but null."""
    t = F.trim(text)
    return F.when(t.rlike(_ZONED), t.try_cast("timestamp"))


def parse_compact(text: Column) -> Column:
    """A timestamp from YYYYMMDDTHHMMSSZ or, else, as parse_aware."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(F.regexp_replace(t, "[TZ]", ""), F.lit("yyyyMMddHHmmss"))), parse_aware(t))


def own_date(text: Column) -> Column:
    """The calendar date that a zoned timestamp names in its own offset."""
    return F.when(parse_aware(text).isNotNull(), F.substring(F.trim(text), 1, 10).try_cast("date"))


def date_agreement(text: Column, day: Column) -> Column:
    """exact, different or missing: whether the timestamp's own date is ``day``."""
    own = own_date(text)
    return F.when(own.isNull() | day.isNull(), "missing").when(own == day, "exact").otherwise("different")


def seconds_of(clock: str) -> int:
    """Seconds since midnight of HH:MM or HH:MM:SS."""
    if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?", clock):
        raise ValueError(f"{clock!r} is no time of day")
    h, m, *s = (int(x) for x in clock.split(":"))
    return 3600 * h + 60 * m + (s[0] if s else 0)


def window_marks(start: datetime, end: datetime, least: int = 15) -> list[datetime]:
    """The moments at which [start, end) can be cut: every ``least`` minutes from the start, the rest going to the last
    part, with both ends."""
    if type(least) is not int or least < 15:
        raise ValueError("a part has 15 minutes at least, in whole minutes")
    if None in (start.tzinfo, end.tzinfo) or not start < end:
        raise ValueError("a window has zones, and its end lies after its start")
    unit = timedelta(minutes=least)
    return [start + k * unit for k in range(max(1, (end - start) // unit))] + [end]


def split_window(start: datetime, end: datetime, least: int = 15) -> tuple[tuple[datetime, datetime], tuple[datetime, datetime]] | None:
    """Both halves of a window, cut at the mark in the middle; None if there is no mark inside."""
    marks = window_marks(start, end, least)
    inside = marks[1:-1]
    if not inside:
        return None
    middle = marks[(len(marks) - 1) // 2]
    return (start, middle), (middle, end)


def window_leaves(start: Column, end: Column, min_minutes: int = 15) -> Column:
    """The leaves of splitting [start, end) as far as split_window goes: array<struct<start, end>>. All but the last
    are of the minimum's length; the last holds the rest."""
    unit = 60 * min_minutes
    first, last = F.unix_timestamp(start), F.unix_timestamp(end)
    n = F.greatest(F.floor((last - first) / unit), F.lit(1))
    at = lambda i: F.timestamp_seconds(first + i * unit)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(at(i).alias("start"), F.when(i == n - 1, end).otherwise(at(i + 1)).alias("end")))


def padded_window(start: datetime, end: datetime, padding: int = 1, least: int = 15) -> tuple[str, str]:
    """The bounds to ask a service for, YYYYMMDDHHMMSS in UTC: the window with ``padding`` seconds around it, since what
    services do at bounds differs; in_scope cuts the answer to [start, end). Windows below ``least`` minutes are an error."""
    if type(padding) is not int or padding < 0:
        raise ValueError("padding is a whole number of seconds")
    first, last = window_marks(start, end, least)[0], end
    if last - first < timedelta(minutes=least):
        raise ValueError(f"a window has {least} minutes at least")
    text = lambda t: t.astimezone(UTC).strftime("%Y%m%d%H%M%S")
    return text(first - timedelta(seconds=padding)), text(last + timedelta(seconds=padding))


def backoff_seconds(attempt: int, first: float, most: float) -> float:
    """Seconds to wait before retry ``attempt`` (from 0): doubled each time, at most ``most``."""
    return min(first * 2**attempt, most)


def plan_windows(start: datetime, end: datetime, full, min_minutes: int = 15) -> list[tuple[datetime, datetime, str]]:
    """The windows that a collector ends with: those for which ``full(start, end)`` is true are split as far as it goes;
    (start, end, completed, split or saturated) in the order of visits."""
    if not full(start, end):
        return [(start, end, "completed")]
    parts = split_window(start, end, min_minutes)
    if parts is None:
        return [(start, end, "saturated")]
    return [(start, end, "split"), *(w for p in parts for w in plan_windows(*p, full, min_minutes))]


#: The grammar of a query's parts: words of a keyword, labels of a domain, a language.
_WORD, _LABEL, _LANGUAGE = re.compile(r"[^\W_](?:[^\W_]|[-'.])*|[-'.]+(?:[^\W_]|[-'.])*"), re.compile(r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)"), re.compile("[A-Za-z]{2,30}")
_OPERATORS = {"AND", "NOT", "OR"}


def _phrase(keyword: str) -> str:
    words = keyword.split(" ") if isinstance(keyword, str) and keyword.isprintable() else []
    words = [w for w in words if w]
    if not words or not all(_WORD.fullmatch(w) for w in words) or (len(words) == 1 and words[0].upper() in _OPERATORS):
        raise ValueError(f"{keyword!r} can't be searched for as it stands")
    return words[0] if len(words) == 1 and words[0].isalnum() else '"' + " ".join(words) + '"'


def build_query(keywords: Sequence[str], domain: str, language: str = "english") -> str:
    """A search query of literal phrases: (a OR "b c") domain:d sourcelang:l. What doesn't fit the grammar of words, labels
    and names is an error, so that data can't change the query."""
    phrases = [] if isinstance(keywords, str | bytes) else [_phrase(k) for k in keywords]
    if not phrases:
        raise ValueError("there are no keywords")
    labels = domain.split(".") if isinstance(domain, str) else []
    if len(labels) < 2 or len(domain) > 253 or not all(map(_LABEL.fullmatch, labels)) or not labels[-1][0].isalpha():
        raise ValueError(f"{domain!r} isn't the bare name of a domain")
    if not isinstance(language, str) or not _LANGUAGE.fullmatch(language):
        raise ValueError(f"{language!r} names no language")
    return " ".join([f"({' OR '.join(phrases)})", f"domain:{domain.lower()}", f"sourcelang:{language.lower()}"])
