"""Inventory tables from CSV and XLSX files, every value as text. A table without a header is an error."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not found.columns:
        raise ValueError("CSV input must contain a header row.")
    return found.toDF(*[c.removeprefix("﻿") for c in found.columns])


def _column(reference: str) -> int:
    """A1 is column 0."""
    at = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet, booleans as true or false."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text
            rows.append(cells)
    return rows


def _header(rows: list[list[str | None]]) -> list[str]:
    """Blank header cells are left out before values are matched by position, so a blank one shifts those after it."""
    names = [v.strip() for v in (rows[0] if rows else []) if v and v.strip()]
    if not names:
        raise ValueError("XLSX input must contain a header row.")
    return names


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet; those without any value are skipped. The file is read by Spark, so any of its file systems does; a workbook is one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def names_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_header(sheet_rows(x)) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["names"])

    found = files.mapInArrow(names_of, "names array<string>").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("XLSX inputs must share one header.")
    names = found[0]["names"]

    def rows_of(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [(r[: len(names)] + [None] * len(names))[: len(names)] for r in sheet_rows(content)[1:]]
                rows = [r for r in rows if any(v is not None and v.strip() for v in r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    return files.mapInArrow(rows_of, StructType([StructField(n, StringType()) for n in names]))


def read(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "xlsx"):
        raise ValueError(f"Unsupported inventory type: {path}")
    return read_csv(spark, path) if suffix == "csv" else read_xlsx(spark, path)


def with_aliases(table: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames columns to the names whose aliases they match once case, blanks, dashes and underscores are levelled; a missing one is an error."""

    def level(name: str) -> str:
        return re.sub(r"[\s_-]+", "_", name.strip().lower())

    by_name = {level(c): c for c in reversed(table.columns)}
    chosen = {name: next((by_name[level(a)] for a in (name, *others) if level(a) in by_name), None) for name, others in aliases.items()}
    if missing := [n for n, c in chosen.items() if c is None]:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    back = {c: n for n, c in chosen.items()}
    return table.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in table.columns])
