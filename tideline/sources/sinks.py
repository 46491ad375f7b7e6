"""Sinks: tables, reports, manifests, with guards."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_paths(*paths: str) -> None:
    """Raises ValueError if two paths are the same or one holds another."""
    full = [Path(p).resolve() for p in paths]
    for i, a in enumerate(full):
        for b in full[i + 1 :]:
            if a == b or a in b.parents or b in a.parents:
                raise ValueError(f"{a} and {b} overlap")


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    """Parquet; readers see it whole or not at all (the commit protocol's success file)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON texts."""
    nested = lambda t: t.startswith(("array", "map", "struct"))
    df.select(*(F.to_json(c).alias(c) if nested(t) else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").csv(path, header=True, escape='"')


def write_text(path: str, text: str) -> None:
    """A small file of the driver's, by a temporary one that replaces it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)


def write_json(path: str, value) -> None:
    """Sorted, indented JSON."""
    write_text(path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n")


def qa_report(df: DataFrame, checks: Mapping[str, Column]) -> dict[str, int]:
    """rows and, by name, the rows that fulfil each condition: one pass."""
    return df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in checks.items())).head().asDict()


def write_dispositions(df: DataFrame, folder: str, column: str = "disposition", kinds: Iterable[str] = ("kept", "quarantined", "excluded")) -> dict[str, int]:
    """One table per disposition and a report with independent counts; a row without a known one is an error."""
    kinds = list(kinds)
    df = df.cache()
    try:
        counts = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
        if set(counts) - set(kinds):
            raise ValueError(f"unknown dispositions: {sorted(map(str, set(counts) - set(kinds)))}")
        for k in kinds:
            write_table(df.where(F.col(column) == k), f"{folder}/{k}")
    finally:
        df.unpersist()
    return {k: counts.get(k, 0) for k in kinds}


def export_splits(rows: DataFrame, path: str, summary_path: str | None = None, date_col: str = "date", target: str = "y", expected: Mapping[str, int] | None = None) -> dict:
    """One folder per split, and their summary (also as JSON at ``summary_path``): rows, bounds and share of positives of
    each, the purged dates, the columns. Sizes other than the ``expected`` ones are an error, before anything is written."""
    found = rows.groupBy("split").agg(F.count("*").alias("rows"), F.min(date_col).cast("string").alias("start_date"), F.max(date_col).cast("string").alias("end_date"), F.round(F.avg(target), 4).alias("share_positive"))
    parts = {r["split"]: {k: r[k] for k in ("rows", "start_date", "end_date", "share_positive")} for r in found.collect()}
    parts.pop("purged", None)
    sizes = {k: v["rows"] for k, v in parts.items()}
    if expected is not None and dict(expected) != sizes:
        raise ValueError(f"the splits have {sizes} rows, expected were {dict(expected)}")
    purged = [str(r[0]) for r in rows.where("split = 'purged'").select(date_col).orderBy(date_col).collect()]  # the purge width, twice
    write_table(rows, path, ["split"])
    summary = {"splits": parts, "purged_dates": purged, "columns": [c for c in rows.columns if c != "split"]}
    if summary_path is not None:
        write_json(summary_path, summary)
    return summary


def sha256_file(path: str) -> str:
    """Digest of a file of the driver's."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _remove(path: str) -> None:
    target = Path(path)
    if target.is_dir() and not target.is_symlink():
        shutil.rmtree(target)
    else:
        target.unlink(missing_ok=True)


def from_source(source: str, output: str, report_path: str, make: Callable[[str, str], Mapping | None]) -> dict:
    """Runs ``make(source, output)``, which writes ``output`` (a file or folder of the driver's) and may return facts for
    the report, a JSON file. An older output goes first and a partial one on failure, so that what is there is valid; the
    source must not change meanwhile. Errors are noted in the report and raised."""
    distinct_paths(source, output, report_path)
    report = {"status": "running", "output_valid": False, "source": source, "output": output, "started": datetime.now(UTC).isoformat()}
    write_json(report_path, report)
    _remove(output)
    try:
        report["source_sha256"] = sha256_file(source)
        report |= make(source, output) or {}
        if sha256_file(source) != report["source_sha256"]:
            raise ValueError(f"{source} changed while it was read")
    except BaseException as e:
        _remove(output)
        write_json(report_path, report | {"status": "failed", "output_valid": False, "error": str(e)[:500]})
        raise
    report |= {"status": "passed", "output_valid": True}
    write_json(report_path, report)
    return report


class Manifest:
    """The stages of a run with their state, saved after each change; a failure is saved, too."""

    def __init__(self, path: str, **settings):
        self.path, self.data = path, {"settings": settings, "stages": {}, "status": "running"}

    def stage(self, name: str, run):
        """run(), its time and outcome being noted."""
        entry = self.data["stages"][name] = {"status": "running", "started": datetime.now(UTC).isoformat()}
        write_json(self.path, self.data)
        try:
            out = run()
        except Exception as e:
            entry |= {"status": "failed", "error": str(e)[:500]}
            self.data["status"] = "failed"
            raise
        else:
            entry["status"] = "completed"
            return out
        finally:
            entry["ended"] = datetime.now(UTC).isoformat()
            write_json(self.path, self.data)

    def finish(self) -> None:
        """Marks the run as completed."""
        self.data["status"] = "completed"
        write_json(self.path, self.data)
