"""Column functions over addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The query keys that only track.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
_PARTS = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_BAD = r"(?U)[\s\x00-\x1f\x7f]"


def _port_ok(authority: Column) -> Column:
    """No port, an empty one, or one up to 65535."""
    port = F.regexp_extract(authority, r"(?<=[^:\]]|\]):([^:\]]*)$", 1)
    has = authority.rlike(r":[^:\]]*$")
    return ~has | (port == "") | (port.rlike(r"^[0-9]{1,5}$") & (F.try_to_number(port, F.lit("99999")) <= 65535))


def _host(authority: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", ""))


def canonical_url(url: Column, hosts: Sequence[str], canonical_host: str) -> Column:
    """https, the canonical host and the path of an address on one of ``hosts``; query and fragment go. Null for other
    hosts and schemes, white space or controls inside, bad ports and paths that don't begin with a slash."""
    u = F.trim(url)
    scheme, authority, path = (F.regexp_extract(u, _PARTS, k) for k in (1, 2, 3))
    good = (
        u.isNotNull() & ~u.rlike(_BAD) & F.lower(scheme).isin("http", "https")
        & _host(authority).isin(*[h.lower() for h in hosts]) & _port_ok(authority) & path.startswith("/")
    )
    return F.when(good, F.concat(F.lit(f"https://{canonical_host}"), path))


def without_tracking(url: Column) -> Column:
    """The address without the tracking keys, else unchanged: case, order, repeats, escapes and fragment stay, and
    names aren't decoded. Null unless http(s) with a host, or with white space, controls, bad escapes or ports."""
    u = F.trim(url)
    scheme, authority = F.regexp_extract(u, _PARTS, 1), F.regexp_extract(u, _PARTS, 2)
    host = _host(authority)
    good = (
        u.isNotNull() & (u != "") & ~u.rlike(_BAD) & ~u.rlike("%(?![0-9A-Fa-f]{2})") & F.lower(scheme).isin("http", "https")
        & (host != "") & ~host.startswith(".") & ~authority.contains("\\") & _port_ok(authority)
    )
    head = F.substring_index(u, "#", 1)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    base = F.substring_index(head, "?", 1)
    parts = F.split(F.substring(head, F.length(base) + 2, F.length(head)), "&")
    kept = F.filter(parts, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS))
    shorter = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(good, F.concat(F.when(head.contains("?") & (F.size(kept) < F.size(parts)), shorter).otherwise(head), tail))


def url_path(url: Column) -> Column:
    """The path of an address, without query and fragment."""
    return F.regexp_extract(url, _PARTS, 3)


def date_in_url(url: Column, suffix: str = ".html") -> Column:
    """The first /YYYY/MM/DD/ of a path that ends with ``suffix``; null if there is none or it is no date."""
    path = url_path(url)
    found = F.regexp_extract(path, r"/(\d{4}/\d{2}/\d{2})/", 1)
    return F.when(path.endswith(suffix), F.to_date(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy/MM/dd"))))


def article_id(url: Column) -> Column:
    """Hex SHA-256 of the address."""
    return F.sha2(url, 256)


def url_words(url: Column) -> Column:
    """The percent-decoded path, each run of - _ / as a space. A plus sign stays one; broken escapes give ""."""
    return F.coalesce(F.regexp_replace(F.try_url_decode(F.regexp_replace(url_path(url), r"\+", "%2B")), "[-_/]+", " "), F.lit(""))
