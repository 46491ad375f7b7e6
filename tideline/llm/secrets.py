"""Secret scans by a battery of randomness tests, in DataFrame functions only.

Fixed patterns find the base spans. Beside them, each long run of encoding characters whose encoding can be inferred is
tested against "its symbols are drawn at random": chi-squared uniformity over the alphabet (pooled so that five symbols
are expected in a cell), runs above and below the alphabet's middle, serial correlation of neighbours; Fisher's method
joins the three in one score, on a fixed grid.

What is reported has to be more random than text. So the null hypothesis of the false-discovery control is "structured":
decoys, identifiers made of words of the corpus and of a fixed text in the styles in which identifiers are written and in
the lengths of the bands, go through the same battery. The p-value of a run is the share of the decoys of its alphabet
and length that look as random, and of all runs of the corpus with the same alphabet and about the same length, the
Benjamini-Hochberg procedure picks those that are reported. Counts per grid cell, one small aggregate, are all it needs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cols, table

#: The base patterns by kind, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs that may be encoded values: maximal, 20 characters or more, padding at the end; not those that end with a name
#: to which a value of ASSIGN is assigned.
RUN = (
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
    r"""(?!(?<=(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6})={0,2}"""
)
#: Assignments come first, so that no run lies in one: the run is the third group.
RUN_OR_ASSIGN = rf"""(?i:{ASSIGN.removeprefix("(?i)")})|({RUN})"""

#: Letters, frequent ones in prose first: random symbols don't mind the order, and text fills the first parts.
_LOWER = "etaoinsrhldcumfpgwybvkxjqz"
_DIGITS = "0123456789"
#: Encodings in the order in which they are tried: the pattern of the whole run, the alphabet, and the numbers of equal parts
#: into which it can be pooled.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "eadcfb" + _DIGITS, (4, 8, 16)),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "EADCFB" + _DIGITS, (4, 8, 16)),
    (r"^(?=.*[A-Z])[A-Z2-7]+={0,2}$", _LOWER.upper() + "234567", (4, 8, 16, 32)),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _LOWER + _DIGITS, (4, 6, 9, 12, 18, 36)),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _LOWER.upper() + _DIGITS, (4, 6, 9, 12, 18, 36)),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+={0,2}$", _LOWER + _LOWER.upper(), (4, 13, 26, 52)),
    (r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+={0,2}$", _LOWER + _LOWER.upper() + _DIGITS + "+/", (4, 8, 16, 32, 64)),
    (r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+={0,2}$", _LOWER + _LOWER.upper() + _DIGITS + "-_", (4, 8, 16, 32, 64)),
)
#: Cells of the grid of scores for each power of ten, and the powers it has.
CELLS, POWERS = 20, 20
#: Share of false discoveries among the runs that are reported, of each alphabet and length.
FDR = 0.05
#: Bands of lengths: a half doubling each from 16 symbols on, the last one open; and of each the length of its decoys.
DECOY_LENGTHS = (20, 24, 34, 48, 66, 92)
#: Words that decoys are made of, in a row, and texts of them that decoys are made of beside the corpus, at most.
WORDS = r"(?:[A-Za-z]{2,14}[^A-Za-z]{1,3}){8,30}"
FIXED_TEXTS = 1500
#: Items that are gathered in one array before it joins the others.
_BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _gathered(items: Column, state: Column, step, kind: str) -> Column:
    """What ``step``(state, item), a pair of the next state and an array of ``kind``, gives for the items one by one, as one
    array. Linear: arrays grow in blocks, which are joined at the end."""
    none = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, i: Column) -> Column:
        block = F.aggregate(F.slice(items, i + 1, _BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(block, lambda b: F.struct(b["state"].alias("state"), F.concat(acc["out"], F.array(b["out"])).alias("out")))

    begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_BLOCK)), begin, outer, lambda acc: F.flatten(acc["out"]))


def _matches(text: Column, pattern: str, group: int, kind: str, made) -> Column:
    """made(begin, end, group's text), arrays of ``kind``, of all leftmost non-overlapping matches, joined; in code points.
    Pieces between matches and matches alternate, hence the places. Linear in the text and the matches."""
    pat = F.lit(pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("p"),
        F.transform(F.regexp_extract_all(text, pat, F.lit(0)), F.length).alias("m"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("g"),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["p"]
        end = begin + x["m"]
        return F.coalesce(end, begin), F.when(x["m"].isNotNull(), made(begin, end, x["g"])).otherwise(F.array().cast(kind))

    found = _let(parts, lambda ps: _gathered(ps, F.lit(0), step, kind))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>>, in code points; only those whose group has
    ``least`` characters."""

    def made(begin: Column, end: Column, found: Column) -> Column:
        here = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.when(F.length(found) >= least, here).otherwise(F.array().cast(_SPANS))

    return _matches(text, pattern, group, _SPANS, made)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(spans_of(text, ASSIGN, 0, 2, 6), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z (an approximation by a polynomial, absolute error under 1e-7, in the far tail
    the leading term)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, f) -> Column:
    """f(value), the value being computed once however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _judge(v: Column, k: Column, pools: Column) -> Column:
    """The grid cell of the joint score of the symbols ``v`` (array<double>) of an alphabet of ``k``, which falls into
    ``pools`` equal parts for the chi-squared test, as many as have five symbols each."""
    g = F.coalesce(F.array_max(F.filter(pools, lambda p: p * 5 <= F.size(v))), F.array_min(pools)).cast("double")
    return _let(g, lambda g: _tested(v, k, g))


def _tested(v: Column, k: Column, g: Column) -> Column:
    cells = F.transform(v, lambda x: F.floor(x * g / k))
    first, second = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
    counted = F.struct(
        F.size(v).cast("double").alias("n"),
        (_sum(v) / F.size(v)).alias("avg"),
        _let(cells, lambda w: _sum(F.transform(F.array_distinct(w), lambda d: F.pow(F.size(F.filter(w, lambda x: x == d)).cast("double"), F.lit(2.0))))).alias("squares"),
        _sum(F.transform(v, lambda x: (x * 2 >= k).cast("double"))).alias("high"),
        (1 + _sum(F.zip_with(first, second, lambda a, b: ((a * 2 >= k) != (b * 2 >= k)).cast("double")))).alias("runs"),
    )

    def moments(c: Column) -> Column:
        mean = 2 * c["high"] * (c["n"] - c["high"]) / c["n"] + 1
        chi = F.greatest(c["squares"] * g / c["n"] - c["n"], F.lit(0.0)) / (g - 1)
        return F.struct(
            c["n"].alias("n"),
            ((F.pow(chi, F.lit(1 / 3)) - (1 - 2 / (9 * (g - 1)))) / F.sqrt(2 / (9 * (g - 1)))).alias("chi"),
            F.try_divide(F.abs(c["runs"] - mean), F.sqrt(F.greatest((mean - 1) * (mean - 2) / (c["n"] - 1), F.lit(0.0)))).alias("runs"),
            _sum(F.transform(v, lambda x: (x - c["avg"]) * (x - c["avg"]))).alias("power"),
            _sum(F.zip_with(first, second, lambda a, b: (a - c["avg"]) * (b - c["avg"]))).alias("lag"),
        )

    def scores(m: Column) -> Column:
        serial = F.abs(F.try_divide(m["lag"], m["power"]) + 1 / m["n"]) * F.sqrt(m["n"])
        return F.array(_upper_tail_of(m["chi"]), *(F.coalesce(F.least(2 * _upper_tail_of(z), F.lit(1.0)), F.lit(0.0)) for z in (m["runs"], serial)))

    def cell(half: Column) -> Column:
        tens = (half - F.log(1 + half + half * half / 2)) / math.log(10)
        return F.floor(F.least(F.greatest(tens, F.lit(0.0)), F.lit(float(POWERS))) * CELLS).cast("int")

    minus_logs = lambda ps: _sum(F.transform(ps, lambda p: -F.log(F.greatest(p, F.lit(1e-30)))))
    return _let(_let(_let(_let(counted, moments), scores), minus_logs), cell)


def _upper_tail_of(z: Column) -> Column:
    """_upper_tail with its argument computed once; null (no variation at all) stays null."""
    return _let(z, _upper_tail)


def battery(run: Column, bands: list[int] | None = None) -> Column:
    """Of one run: struct(band int, cell int): the class of alphabet and length in which it is judged, and the grid
    cell of its score, 0 for the most random; null where no encoding fits, or where ``bands`` are given and have another. Padding doesn't count."""

    def judged(run: Column) -> Column:
        body = F.regexp_replace(run, "=+$", "")
        which = F.coalesce(*(F.when(run.rlike(e[0]), F.lit(i)) for i, e in enumerate(ENCODINGS)), F.lit(-1))
        return F.struct(body.alias("body"), which.alias("which"))

    def tested(x: Column) -> Column:
        alphabet = F.element_at(F.array(*(F.lit(e[1]) for e in ENCODINGS)), x["which"] + 1)
        pools = F.element_at(F.array(*(F.array(*(F.lit(g) for g in e[2])) for e in ENCODINGS)), x["which"] + 1)
        symbols = F.transform(F.filter(F.split(x["body"], ""), lambda c: c != ""), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))
        length = F.least(F.floor(F.log2(F.length(x["body"]) / 16) * 2), F.lit(len(DECOY_LENGTHS) - 1))
        band = (length + 100 * x["which"]).cast("int")
        cell = _let(symbols, lambda v: _judge(v, F.length(alphabet).cast("double"), pools))
        fits = (x["which"] >= 0) & (F.length(x["body"]) >= 20)
        return _let(band, lambda b: F.when(fits & (b.isin(bands) if bands is not None else F.lit(True)), F.struct(b.alias("band"), cell.alias("cell"))))

    return _let(_let(run, judged), tested)


_TESTED = "array<struct<start:int,kind:int,end:int,test:struct<band:int,cell:int>>>"


def tested_runs(text: Column) -> Column:
    """The tested runs that touch no base span: access and hex spans lie in one run, and assignments are matched first."""

    def made(begin: Column, end: Column, run: Column) -> Column:
        free = (F.length(run) > 0) & ~run.rlike(ACCESS) & ~run.rlike(HEX)
        here = lambda t: F.array(F.struct(begin.alias("start"), F.lit(3).alias("kind"), end.alias("end"), t.alias("test")))
        none = F.array().cast(_TESTED)
        return F.when(free, _let(battery(run), lambda t: F.when(t.isNotNull(), here(t)).otherwise(none))).otherwise(none)

    return _matches(text, RUN_OR_ASSIGN, 3, _TESTED, made)


def _with_runs(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, then the text, its base spans and its tested runs, named by place as _NAMES after them."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.select(*cols(keep), text.alias("__"))
    found = found.toDF(*(f"c{i}" for i in range(len(keep))), "text")
    return found.select("*", base_spans(F.col("text")).alias("base"), tested_runs(F.col("text")).alias("runs"))


def _decoys(words: Column, style: Column, salt: Column) -> Column:
    """array<string>: the words as an identifier in one of nine styles, cut to each of DECOY_LENGTHS."""
    digit = F.pmod(salt, F.lit(10)).cast("string")
    join = lambda f, by: F.array_join(F.transform(words, f), by)
    of_hex = lambda w: F.concat(F.regexp_replace(F.lower(w), "[^a-f]", ""), F.length(w).cast("string"))
    # the text, and whether a digit ends it
    styles = (
        (join(F.initcap, ""), False), (join(F.initcap, ""), True), (join(F.lower, ""), True), (join(F.upper, ""), True), (join(F.upper, ""), False), (join(F.initcap, "_"), True),
        (join(F.initcap, "/"), True), (join(of_hex, ""), False), (F.upper(join(of_hex, "")), False),
    )
    body = F.coalesce(*(F.when(style == i, t) for i, (t, _) in enumerate(styles)))
    ends = F.coalesce(*(F.when(style == i, F.lit(e)) for i, (_, e) in enumerate(styles)))
    cut = lambda n: F.when(F.length(body) >= n, F.when(ends, F.concat(F.substring(body, 1, n - 1), digit)).otherwise(F.substring(body, 1, n)))
    return F.filter(F.array(*(cut(n) for n in DECOY_LENGTHS)), lambda x: x.isNotNull())


STYLES = 9


def _fixed_texts() -> list[str]:
    """Passages of the Python documentation: prose that any installation holds."""
    from pydoc_data import topics

    found = [m[0] for key in sorted(topics.topics) for m in re.finditer(WORDS, topics.topics[key])]
    return found[:: max(1, len(found) // FIXED_TEXTS)][:FIXED_TEXTS]


def decoys(docs: DataFrame, text_col: str) -> DataFrame:
    """(run): of each text one passage of words, picked by the text's hash, in one style and all lengths; and of the fixed
    texts those in every style."""
    text = docs[text_col].cast("string")
    salt = F.xxhash64(text)
    passages = docs.select(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("p"), salt.alias("salt")).where(F.size("p") > 0)
    one = passages.select(F.element_at("p", (F.pmod("salt", F.size("p")) + 1).cast("int")).alias("p"), "salt", F.pmod(F.xxhash64(F.lit("style"), "salt"), F.lit(STYLES)).alias("style"))
    fixed = docs.sparkSession.createDataFrame([(p,) for p in _fixed_texts()], "p string").select("p", F.xxhash64("p").alias("salt"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(STYLES)))).alias("style"))
    words = F.filter(F.split(F.regexp_replace("p", "[^A-Za-z]+", " "), " "), lambda w: w != "")
    return one.unionByName(fixed).select(words.alias("w"), "style", "salt").select(F.explode(_decoys(F.col("w"), F.col("style"), F.col("salt"))).alias("run"))


def reported_cells(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[int, int]:
    """By band the largest grid cell whose runs are reported. There are at most len(ENCODINGS) x len(DECOY_LENGTHS) bands,
    and cells per band are fixed, too."""
    runs = _with_runs(docs, text_col, ()).select(F.explode("runs").alias("r")).select("r.test.band", "r.test.cell").groupBy("band", "cell").agg(F.count("*").alias("n"))
    found = {(r.band, r.cell): r.n for r in runs.collect()}
    if not found:
        return {}
    tested = decoys(docs, text_col).select(battery(F.col("run"), sorted({b for b, _ in found})).alias("t")).where("t is not null").groupBy("t.band", "t.cell").agg(F.count("*").alias("n"))
    null = {(r.band, r.cell): r.n for r in tested.collect()}
    picked = {}
    for band in sorted({b for b, _ in found}):
        counts = {c: n for (b, c), n in found.items() if b == band}
        like = {c: n for (b, c), n in null.items() if b == band}
        total, decoy_total = sum(counts.values()), sum(like.values())
        below = 0
        for cell in sorted(counts):
            below += counts[cell]
            p = (1 + sum(n for c, n in like.items() if c <= cell)) / (1 + decoy_total)
            if p <= fdr * below / total:
                picked[band] = cell
    return picked


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "", fdr: float = FDR) -> DataFrame:
    """Secrets in each text.

    Returns the columns ``keep`` and, named after ``prefix``, base and spans: array<struct<start, kind, end>>, ordered,
    in code points, ends exclusive, kinds by their place in KINDS; spans has the base spans and those that the battery
    adds. Null and empty texts have none. What is added depends on the corpus, as the false-discovery control does;
    base spans don't. Rows repeat as they come; no shuffle but small aggregates of grid cells. The work for one text is
    linear in it. ``docs`` may have columns of any name."""
    limits = reported_cells(docs, text_col, fdr)
    found = _with_runs(docs, text_col, keep)
    none = F.array().cast(_SPANS)
    if limits:
        known = F.create_map(*(F.lit(x) for kv in sorted(limits.items()) for x in kv))
        random = F.filter("runs", lambda r: r["test"]["cell"] <= F.coalesce(F.try_element_at(known, r["test"]["band"]), F.lit(-1)))
        added = F.transform(random, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
        every = F.when(F.size("runs") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    else:
        every = F.concat("base", none)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(*kept, F.col("base").alias(f"{prefix}base"), every.alias(f"{prefix}spans"), *([F.col("text").alias(f"{prefix}text")] if prefix else []))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; other columns, null texts and row count stay. Linear
    in the text: with many secrets it is cut character by character."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text_col)]
    found = scan(docs.toDF(*names), own, tuple(names), "secret_", fdr)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.array(F.struct(at.alias("a"), s["start"].alias("b")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast(pieces))

    pieces = "array<struct<a:int,b:int>>"
    text = F.col("secret_text")
    last = F.array_max(F.transform("secret_spans", lambda s: s["end"]))
    kept = F.concat(_gathered(F.col("secret_spans"), F.lit(0), step, pieces), F.array(F.struct(last.alias("a"), F.length(text).alias("b"))))
    few = F.array_join(F.transform("kept", lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"])), mark)
    many = _let(F.split(text, ""), lambda chars: F.array_join(F.transform("kept", lambda p: F.array_join(F.slice(chars, p["a"] + 1, p["b"] - p["a"]), "")), mark))
    found = found.withColumn("kept", F.when(F.size("secret_spans") > 0, kept))
    cleaned = F.when(F.col("kept").isNull(), F.col(own)).when(F.size("kept") <= 50, few).otherwise(many)
    return found.select(*(cleaned.alias(c) if k == own else F.col(k).alias(c) for k, c in zip(names, docs.columns, strict=True)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
