"""Sinks: CSV and JSON exports, the text report, profile and adapter descriptions."""

from __future__ import annotations

import json
import posixpath
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _put(spark: SparkSession, path: str, text: str) -> str:
    """A small driver-side file, through the cluster's file system."""
    out = _streamed(spark, path)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, strict: bool = False, one_file: bool = False) -> str:
    """K4: the columns in order; further ones are left out, or are an error if strict; absent ones are ''."""
    columns = columns or df.columns
    if strict and set(df.columns) - set(columns):
        raise ValueError(f"columns without a place: {sorted(set(df.columns) - set(columns))}")
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')
    return path


def write_json(df: DataFrame, path: str, one_file: bool = False) -> str:
    """A record a line, UTF-8 as it is, in as many files as there are tasks."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def _streamed(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)


def write_json_list(df: DataFrame, path: str, indent: int = 2) -> str:
    """K3: one file with one list, indented, UTF-8 as it is. Records pass through the driver a partition at a time, so this is for
    results that a person reads; write_json() is for all others."""
    out, n = _streamed(df.sparkSession, path), 0
    try:
        for row in df.toLocalIterator():
            text = json.dumps(row.asDict(recursive=True), indent=indent, ensure_ascii=False, default=str)
            lead = "[\n" if n == 0 else ",\n"
            out.write(bytearray((lead + "\n".join(" " * indent + line for line in text.split("\n"))).encode()))
            n += 1
        out.write(bytearray(b"\n]\n" if n else b"[]\n"))
    finally:
        out.close()
    return path


#: Rows of a sheet, the header among them.
SHEET_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str) -> str | None:
    """The third format of K1, best effort: None where the writer's library is not installed. Rows beyond a sheet go to another
    sheet; they pass through the driver a partition at a time."""
    try:
        from openpyxl import Workbook
    except ImportError:
        return None
    import io

    book = Workbook(write_only=True)
    sheet, left = None, 0
    for row in df.toLocalIterator():
        if not left:
            sheet, left = book.create_sheet(), SHEET_ROWS - 1
            sheet.append(df.columns)
        sheet.append(list(row))
        left -= 1
    if sheet is None:
        book.create_sheet().append(df.columns)
    held = io.BytesIO()
    book.save(held)
    out = _streamed(df.sparkSession, path)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
    return path


def report(url: str, pages: int, kept: int, junk: int, duplicates: int, fields: list[str], engine: str) -> str:
    """K2. Removed records are told apart and in sum."""
    return "\n".join([f"URL: {url}", f"Pages: {pages}", f"Records: {kept}", f"Removed: {junk + duplicates} ({junk} junk, {duplicates} duplicates)", f"Fields: {', '.join(fields)}", f"Engine: {engine}", ""])


def export(df: DataFrame, folder: str, fields: list[str], formats: tuple[str, ...] = ("csv", "json", "xlsx"), text: str = "", one_file: bool = False) -> dict:
    """K1, K7: the formats that are asked for and can be written, and the report. Without rows nothing is written and the status is failed.
    one_file gives one CSV part and one indented JSON list, through one task or the driver; the default leaves the rows spread."""
    n = df.count()
    if not n:
        return {"status": "failed", "records_extracted": 0}
    spark, files = df.sparkSession, {}
    rows = df.select(*fields)
    if "csv" in formats:
        files["csv"] = write_csv(rows, posixpath.join(folder, "csv"), fields, one_file=one_file)
    if "json" in formats:
        files["json"] = write_json_list(rows, posixpath.join(folder, "results.json")) if one_file else write_json(rows, posixpath.join(folder, "json"))
    if ("xlsx" in formats or "excel" in formats) and (made := write_xlsx(rows, posixpath.join(folder, "results.xlsx"))):
        files["xlsx"] = made
    if text:
        files["report"] = _put(spark, posixpath.join(folder, "report.txt"), text)
    return {"status": "success", "records_extracted": n, "files": files}


def save_profile(spark: SparkSession, profile, path: str) -> str:
    """K6: a profile (a Row, dict or dataclass) as indented JSON."""
    value = asdict(profile) if is_dataclass(profile) else profile.asDict(recursive=True) if hasattr(profile, "asDict") else dict(profile)
    return _put(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def describe_adapter(name: str, profile: dict, schema: dict) -> str:
    """K6: an adapter's description in Markdown."""
    lines = [f"# Adapter: {name}", "", f"Page type: {profile.get('page_type', 'unknown')}; confidence {profile.get('confidence', 0):.2f}", "", "## Fields", "", "| Field | Type | Required | Source |", "|---|---|---|---|"]
    lines += [f"| {f['name']} | {f['type_hint']} | {'yes' if f['required'] else 'no'} | {f['source']} |" for f in schema.get("fields", [])]
    lines += ["", "## Checks", "", *(f"- {r['field']}: {r['rule']}" for r in schema.get("rules", [])), ""]
    return "\n".join(lines)
