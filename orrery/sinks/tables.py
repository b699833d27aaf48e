"""Sinks: CSV and JSON lines by Spark's writers; a workbook, an HTML sheet and a manifest for results a person reads."""

from __future__ import annotations

import html
import json
import zipfile
from collections.abc import Callable, Iterable
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Fixed values.
VERDICTS = ("KEEP", "REVIEW", "LET-GO")
WIDEST, SAMPLED, MOST_ROWS = 48, 100, 1_048_575


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in the order given, null as nothing, booleans as True and False."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.initcap(F.col(c).cast("string")).alias(c) if isinstance(kinds[c], BooleanType) else F.col(c) for c in columns or df.columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines, ordered over all files, timestamps rounded to 6 digits; absent values are left out."""
    held = df.withColumn("timestamp_s", F.round("timestamp_s", 6)) if "timestamp_s" in df.columns else df
    held.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def summary(df: DataFrame, verdict: str = "recommendation") -> DataFrame:
    """name, n: all rows, then each verdict, with 0 for those that don't occur."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in counts.columns])).alias("x")).select("x.*")


def _put(spark: SparkSession, path: str, write: Callable) -> None:
    """Writes to a path of any file system that Spark knows, by a local file of the driver."""
    import os
    import tempfile

    handle, local = tempfile.mkstemp()
    os.close(handle)
    try:
        write(local)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)
    finally:
        os.unlink(local)


def _letters(at: int) -> str:
    name = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(place: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}"><v>{value}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(columns: list[str], rows: Iterable[tuple], out) -> None:
    rows = iter(rows)
    head = list(islice(rows, SAMPLED))
    widths = [min(WIDEST, 2 + max([len(c), *(len(str(r[i])) for r in head if r[i] is not None)])) for i, c in enumerate(columns)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    out.write(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>'.encode())
    n = 0
    for n, row in enumerate((tuple(columns), *head), 1):
        out.write(f'<row r="{n}">{"".join(_cell(f"{_letters(i)}{n}", v) for i, v in enumerate(row))}</row>'.encode())
    for n, row in enumerate(rows, n + 1):
        if n > MOST_ROWS + 1:
            raise ValueError(f"A sheet holds at most {MOST_ROWS} rows; write CSV instead.")
        out.write(f'<row r="{n}">{"".join(_cell(f"{_letters(i)}{n}", v) for i, v in enumerate(row))}</row>'.encode())
    out.write(f'</sheetData><autoFilter ref="A1:{_letters(max(0, len(columns) - 1))}{max(1, n)}"/></worksheet>'.encode())


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One sheet for each DataFrame, with a frozen header and a filter. Rows stream through the driver a partition at a time; more than a sheet holds is an error."""
    spark, names = next(iter(sheets.values())).sparkSession, list(sheets)
    types = "http://schemas.openxmlformats.org/package/2006/content-types"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def write(local: str) -> None:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as book:
            overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for i in range(1, len(names) + 1))
            book.writestr("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>{overrides}</Types>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
            book.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
            for i, df in enumerate(sheets.values(), 1):
                with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    _sheet(df.columns, map(tuple, df.toLocalIterator()), out)

    _put(spark, path, write)


def write_cards(df: DataFrame, path: str, title: str, rejected: str | None = None) -> None:
    """An HTML sheet with a card for each row: its values, without nulls and false ones; values of rejected rows are marked as ignored. Escaped throughout."""

    def write(local: str) -> None:
        with open(local, "w", encoding="utf-8") as out:
            out.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>\n")
            for row in df.toLocalIterator():
                values = [f"{k}: {v}" for k, v in row.asDict().items() if k != rejected and v is not None and v is not False]
                prefix = "ignored candidate values: " if rejected and row[rejected] else ""
                out.write(f"<section>{html.escape(prefix + ', '.join(values))}</section>\n")

    _put(df.sparkSession, path, write)


def write_manifest(df: DataFrame, warnings: DataFrame, path: str, verdict: str = "recommendation") -> dict:
    """Counts of verdicts and the first 100 warnings, as JSON."""
    document = {"counts": {r["name"]: r["n"] for r in summary(df, verdict).collect()}, "warnings": [r[0] for r in warnings.orderBy(*warnings.columns).limit(100).collect()]}

    def write(local: str) -> None:
        with open(local, "w", encoding="utf-8") as out:
            json.dump(document, out, indent=2)

    _put(df.sparkSession, path, write)
    return document
