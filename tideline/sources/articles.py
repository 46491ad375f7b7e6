"""Metadata of article pages: a fixed hierarchy over structured data, meta tags, embedded state and markup."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.values import parse_aware

#: Names under which pages give a publication time or a section. Which of them a page gives first counts.
META_TIMES = ("article:published_time", "og:article:published_time", "datePublished", "parsely-pub-date", "sailthru.date", "pubdate")
STATE_TIMES = ("datePublished", "publishedDate", "publishDate", "published_at")
STATE_SECTIONS = ("articleSection", "sectionName", "section")
_AWARE = re.compile(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Page(HTMLParser):
    """Collects scripts, meta tags, the canonical link, the title, and <time> tags with their parent's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scripts: list[tuple[str, str]] = []
        self.meta: list[tuple[str, str]] = []
        self.canonical = self.lang = None
        self.title = ""
        self.times: list[tuple[str, list[str]]] = []
        self._open: list[tuple[str, list[str], list[int]]] = []
        self._script: list[str] | None = None
        self._type = ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            self._script, self._type = [], a.get("type", "").lower()
        elif tag == "meta":
            name = a.get("property") or a.get("name") or a.get("itemprop")
            if name and a.get("content"):
                self.meta.append((name, a["content"]))
        elif tag == "link" and "canonical" in a.get("rel", "").split() and self.canonical is None:
            self.canonical = a.get("href")
        elif tag == "html":
            self.lang = a.get("lang")
        if tag == "time" and "datetime" in a:
            self.times.append((a["datetime"], []))
            if self._open:
                self._open[-1][2].append(len(self.times) - 1)
        if tag not in _VOID:
            self._open.append((tag, [], []))

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            self.scripts.append((self._type, "".join(self._script)))
            self._script = None
        if any(t == tag for t, _, _ in self._open):
            while self._open:
                name, words, times = self._open.pop()
                for k in times:
                    self.times[k][1].extend(words)
                if self._open:
                    self._open[-1][1].extend(words)
                if name == tag:
                    break

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)
            return
        if self._open:
            self._open[-1][1].append(data)
            if self._open[-1][0] == "title":
                self.title += data

    def close(self):
        super().close()
        while self._open:
            _, words, times = self._open.pop()
            for k in times:
                self.times[k][1].extend(words)


def walk(value) -> Iterator[dict]:
    """All objects inside a JSON value, outer ones first."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from walk(v)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v)


def embedded_json(text: str, marker: str) -> list:
    """The JSON values that directly follow each ``marker`` (and an equals sign)."""
    out = []
    for m in re.finditer(re.escape(marker) + r"\s*=\s*", text):
        try:
            out.append(json.JSONDecoder().raw_decode(text, m.end())[0])
        except ValueError:
            continue
    return out


def find_payload(value, keys: set[str]) -> dict:
    """The only object inside ``value`` that has all ``keys``; none or several different ones are an error."""
    found = []
    for node in walk(value):
        if keys <= node.keys() and node not in found:
            found.append(node)
    if len(found) != 1:
        raise ValueError(f"expected one payload, found {len(found)}")
    return found[0]


def _kinds(node: dict) -> list[str]:
    kind = node.get("@type")
    return [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]


def _sorted(values: Iterable[str]) -> list[str]:
    """The distinct values that aren't blank, without regard to case in their order."""
    return sorted({v.strip() for v in values} - {""}, key=lambda v: (v.casefold(), v))


def _texts(value) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else []
    return _sorted(str(p) for p in parts if isinstance(p, str | int | float))


def _first_named(pairs: Iterable[tuple[str, object]], names: Iterable[str]) -> Iterator[tuple[object, str]]:
    """(value, name as the page spells it) of the pairs with one of the names in either case, in the page's order."""
    wanted = {n.casefold() for n in names}
    return ((v, k) for k, v in pairs if k.casefold() in wanted and v not in (None, "", []) and not (isinstance(v, str) and not v.strip()))


def metadata(html: str | None, url: str | None) -> dict:
    """published, timestamp_source, section, section_source, headline, canonical_url, keywords, authors, lang of a page.
    Times need an offset. Among tags, and among the values of embedded state, the first in the page counts; keywords and
    authors are sorted sets. Null or empty pages have none of these but a section from the address."""
    page = _Page()
    page.feed(html or "")
    page.close()
    nodes = []
    for kind, body in page.scripts:
        if kind == "application/ld+json":
            try:
                nodes += walk(json.loads(body))
            except ValueError:
                continue
    articles = sorted((n for n in nodes if {"NewsArticle", "Article"} & set(_kinds(n))), key=lambda n: "NewsArticle" not in _kinds(n))
    primary = articles[0] if articles else {}
    states = [n for kind, body in page.scripts if kind != "application/ld+json" for m in re.finditer(r"[\w.$\]]\s*=\s*(?=[{\[])", body) for n in walk(_decoded(body, m.end()))]
    none = (None, None)
    meta = lambda names: next(_first_named(page.meta, names), none)
    state = lambda names: next(_first_named((pair for n in states for pair in n.items()), names), none)
    good = lambda v: isinstance(v, str) and bool(_AWARE.match(v.strip()))

    published = source = None
    for n in articles:
        if good(n.get("datePublished")):
            published, source, primary = n["datePublished"], "jsonld.datePublished", n
            break
    if published is None:
        published, source = next(((v, f"meta.{k}") for v, k in _first_named(page.meta, META_TIMES) if good(v)), none)
    if published is None:
        v, k = state(STATE_TIMES)
        published, source = (v, f"structured.{k}") if good(v) else none
    if published is None:
        published, source = next(((v, "rendered.time.datetime") for v, words in page.times if "publish" in " ".join(" ".join(words).split()).casefold() and good(v)), none)

    text = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    section, section_source = text(primary.get("articleSection")), "jsonld.articleSection"
    subsection, name = meta(("article:section", "section"))
    if section is None:
        section, section_source = text(subsection), f"meta.{name}"
    if section is None:
        v, k = state(STATE_SECTIONS)
        section, section_source = text(v), f"structured.{k}"
    if section is None:
        parts = [p for p in urlsplit(url or "").path.split("/") if p]
        section = parts[0] if parts and not parts[0].isdigit() and parts[0] != "video" else None
        section_source = "canonical_url_path_fallback"
    keywords = _texts(primary.get("keywords")) or _texts(meta(("news_keywords", "keywords"))[0])
    authors = primary.get("author")
    authors = [a.get("name") if isinstance(a, dict) else a for a in (authors if isinstance(authors, list) else [authors])]
    headline = text(primary.get("headline")) or text(meta(("og:title", "twitter:title"))[0]) or text(" ".join(page.title.split()))
    return {
        "published": text(published), "timestamp_source": source, "section": section, "section_source": section_source if section else None, "subsection": text(subsection), "headline": headline,
        "canonical_url": page.canonical, "keywords": keywords, "categories": _sorted(x for x in [section, text(subsection), *keywords] if x),
        "authors": _sorted(a for a in authors if isinstance(a, str)), "lang": page.lang,
    }


def _decoded(body: str, at: int):
    try:
        return json.JSONDecoder().raw_decode(body, at)[0]
    except ValueError:
        return None


SCHEMA = (
    "published string, timestamp_source string, section string, section_source string, subsection string, headline string, canonical_url string, "
    "keywords array<string>, categories array<string>, authors array<string>, lang string"
)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zone: str = "Asia/Jakarta") -> DataFrame:
    """Metadata of each page: id, the fields of SCHEMA, published_at_utc, published_local (wall time in ``zone``) and
    timestamp_status. Markup needs a parser, hence Arrow batches through Python; the rest is the JVM's."""
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(picked.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            rows = [metadata(h, u) for h, u in zip(b["html"], b["url"], strict=True)]
            yield pd.DataFrame({"id": b["id"]} | {n: pd.Series([r[n] for r in rows], index=b.index, dtype=object) for n in names})

    found = picked.mapInPandas(run, f"id {kind}, {SCHEMA}")
    utc = parse_aware(F.col("published"))
    return found.withColumns({"published_at_utc": utc, "published_local": F.from_utc_timestamp(utc, zone), "timestamp_status": F.when(utc.isNull(), "missing_publisher_timestamp").otherwise("exact_publisher_timestamp")})
