"""Typed table sources."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.functions.values import parse_date, parse_rate


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, if it has the columns; else ValueError naming those that lack."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: Sequence[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """A CSV with a header and a declared schema (nothing is inferred); ``columns`` prunes; ``keep_empty`` reads empty
    text cells as "" rather than null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    df = df.select(*columns) if columns else df
    return df.na.fill("") if keep_empty else df


def read_series(spark: SparkSession, path: str, date_col: str, rate_col: str) -> DataFrame:
    """(date, rate) of a CSV price series."""
    df = spark.read.csv(path, header=True)
    return require_columns(df, [date_col, rate_col]).select(F.col(date_col).cast("date").alias("date"), F.col(rate_col).cast("double").alias("rate"))


def locate(root: str, pattern: str = "*.xlsx") -> Path:
    """The only file below ``root`` that fits; none or several are an error."""
    found = sorted(p for p in Path(root).glob(pattern) if not p.name.startswith("~$"))
    if len(found) != 1:
        raise ValueError(f"expected one {pattern} in {root}, found {len(found)}")
    return found[0]


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(path: str) -> dict[str, list[list[str | None]]]:
    """All sheets of an XLSX file as rows of texts; dates by their number format as ISO texts. A workbook is a file for
    the driver, small by its format (about a million rows a sheet)."""
    with zipfile.ZipFile(path) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in parse("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = parse("xl/styles.xml")
            custom = {int(f.get("numFmtId")) for f in styles.findall(".//m:numFmt", _NS) if re.search("[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dated = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in custom | {*range(14, 23), *range(45, 48)}}
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in parse("xl/workbook.xml").findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows: list[list[str | None]] = []
            for row in parse(target if target.startswith("xl/") else f"xl/{target}").findall("m:sheetData/m:row", _NS):
                cells: list[str | None] = []
                for k, c in enumerate(row.findall("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else k
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.findtext("m:v", None, _NS), c.get("t", "n")
                    if kind == "s":
                        value = strings[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif kind == "n" and value and int(c.get("s", 0)) in dated:
                        value = (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat(sep=" ", timespec="minutes")
                    cells[at] = value
                index = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(index - 1 - len(rows))] + [cells]
            out[sheet.get("name")] = rows
    return out


def extract_table(sheets: Mapping[str, Sequence[Sequence]], headers: Sequence[str]) -> list[tuple]:
    """(source_row, cells by header...) below the only row, of any sheet, that has each header once (case and spaces
    aside); blank rows are skipped. No such row or several are an error."""
    wanted = [h.strip().casefold() for h in headers]
    found = []
    for rows in sheets.values():
        for i, row in enumerate(rows):
            cells = [str(c).strip().casefold() if c is not None else "" for c in row]
            if all(cells.count(h) == 1 for h in wanted):
                found.append((rows, i, [cells.index(h) for h in wanted]))
    if len(found) != 1:
        raise ValueError(f"expected one header row, found {len(found)}")
    rows, i, at = found[0]
    get = lambda row, k: row[k] if k < len(row) else None
    picked = [(n + 1, *(get(r, k) for k in at)) for n, r in enumerate(rows) if n > i]
    return [r for r in picked if any(c is not None and str(c).strip() for c in r[1:])]


def parse_rates(cells: DataFrame) -> DataFrame:
    """(source_row, date_raw, rate_raw) with date, rate and problem: missing_date, invalid_date, missing_rate,
    invalid_rate, duplicate_date or null. Every member of a group of equal dates is a duplicate."""
    from pyspark.sql import Window

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = cells.withColumn("date", parse_date(F.col("date_raw"))).withColumn("rate", parse_rate(F.col("rate_raw")))
    same = F.count("date").over(Window.partitionBy("date")) > 1
    problem = (
        F.when(blank("date_raw"), "missing_date").when(F.col("date").isNull(), "invalid_date").when(blank("rate_raw"), "missing_rate")
        .when(F.col("rate").isNull(), "invalid_rate").when(same, "duplicate_date")
    )
    return out.withColumn("problem", problem)


def clean_rates(cells: DataFrame, strict: bool = True) -> DataFrame:
    """(date, rate) of the cells. Strict: any problem fails the whole table, with its rows in the message. Lenient: bad
    rows drop out, of equal dates the first row stays."""
    parsed = parse_rates(cells)
    if strict:
        bad = parsed.where("problem is not null").orderBy("source_row").limit(20).collect()
        if bad:
            raise ValueError("; ".join(f"row {r.source_row}: {r.problem}" for r in bad))
        return parsed.select("date", "rate")
    from tideline.operators.dedup import keep_first

    return keep_first(parsed.where(F.col("date").isNotNull() & F.col("rate").isNotNull()), ["date"], ["source_row"]).select("date", "rate")


def check_range(start: date, end: date, longest_days: int, bounds: tuple[date, date] | None = None, allow_outside: bool = False) -> None:
    """Raises ValueError for empty ranges, ranges over ``longest_days``, and, unless allowed, outside ``bounds``."""
    if end < start:
        raise ValueError("the range ends before it begins")
    if (end - start).days + 1 > longest_days:
        raise ValueError(f"the range is longer than {longest_days} days")
    if bounds and not allow_outside and not (bounds[0] <= start and end <= bounds[1]):
        raise ValueError("the range leaves the study's bounds")


def missing_bucket(column: str, name: str = "(missing)") -> Column:
    """The column as text, null and empty as ``name``."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(name))
