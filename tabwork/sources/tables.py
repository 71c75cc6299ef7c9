"""Reading many files as one table, and writing results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.combine import stack
from .csv_files import csv_cells, file_info, load_files, read_csv  # noqa: F401  the readers of this module

CELLS = "file string, sheet string, row int, col int, value string"


def load(tables: dict[str, DataFrame], files: list[str] | None = None, common_only: bool = False) -> DataFrame:
    """The chosen tables as one, each row with its source; tables without columns are left out."""
    chosen = {n: t for n, t in tables.items() if (files is None or n in files) and t.columns}
    if not chosen:
        raise ValueError("no table to load")
    return stack([t.withColumn("source", F.lit(n)) for n, t in chosen.items()], common_only)


def inventory(df: DataFrame, source: str = "source") -> DataFrame:
    """Per source: rows, columns, missing cells, types."""
    columns = [c for c in df.columns if c != source]
    kinds = ", ".join(f"{c}:{t}" for c, t in df.dtypes if c != source)
    missing = sum((F.count("*") - F.count(F.col(c)) for c in columns), F.lit(0))
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.lit(len(columns)).cast("long").alias("columns"), missing.cast("long").alias("missing"), F.lit(kinds).alias("types"))


def file_sizes(df: DataFrame) -> DataFrame:
    """file, kilobytes, rows of a table read from files."""
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("file").agg(F.round(F.max("size") / 1024, 1).alias("kilobytes"), F.count("*").alias("rows"))


def sheets(cells: DataFrame) -> DataFrame:
    """file, sheets (their names, comma-joined, in order of name), rows, filled_cells of the workbooks whose cells these are."""
    names = F.array_join(F.array_sort(F.collect_set("sheet")), ",")
    return cells.groupBy("file").agg(names.alias("sheets"), F.count_distinct("sheet", "row").alias("rows"), F.count("value").alias("filled_cells"))


def save(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists", filename: str | None = None) -> str:
    """Saves df at path, or under a name in that folder, with the format as its ending; returns where. It is a folder of part files."""
    if filename:
        path = f"{path.rstrip('/')}/{filename.removesuffix('.' + format)}.{format}"
    if format not in ("csv", "parquet", "json", "orc"):
        raise ValueError("format must be csv, parquet, json or orc")
    writer = df.write.mode(mode).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)
    return path


def preview(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(order).limit(n).select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def head_sample(df: DataFrame, source: str, order: str, n: int = 2, width: int = 30) -> DataFrame:
    """The first rows of each source, values as text of limited width."""
    first = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return df.withColumn("_n", first).filter(F.col("_n") <= n).select(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns])


def _sheet_cells(file: str, content: bytes) -> Iterator[tuple]:
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iterfind(".//m:t", space)) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", space):
            target = targets[sheet.get(link)]
            page = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for cell in page.iterfind(".//m:c", space):
                letters, row = re.match(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                kind, value = cell.get("t"), cell.find("m:v", space)
                text = "".join(t.text or "" for t in cell.iterfind(".//m:t", space)) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                yield file, sheet.get("name"), int(row), col, text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all sheets of the xlsx files at a path: file, sheet, row, col (from 1), value. One task reads a workbook at a time."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(_sheet_cells(file.rsplit("/", 1)[-1], content), columns=["file", "sheet", "row", "col", "value"])

    return books.mapInPandas(cells, CELLS)
