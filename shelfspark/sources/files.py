"""Spreadsheet files as cells: (file, sheet_no, row_no, col_no, value), read by Spark as binary files and parsed one file at a time."""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CELLS = "file string, sheet_no int, row_no bigint, col_no int, value string"


def delimiter_of(head: str) -> str:
    """The delimiter of a file that begins with head."""
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def csv_rows(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    csv.field_size_limit(sys.maxsize)
    text = data.decode("utf-8-sig", errors="replace")
    delimiter = delimiter_of(text[:8192])
    for r, row in enumerate((row for row in csv.reader(io.StringIO(text), delimiter=delimiter) if any(x.strip() for x in row)), 1):
        for c, x in enumerate(row, 1):
            if x.strip():
                yield 1, r, c, x.strip()


def xlsx_rows(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    local = lambda e: e.tag.rpartition("}")[2]
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = [text_of(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for number, name in sheets:
            for _, e in ElementTree.iterparse(io.BytesIO(z.read(name))):
                if local(e) != "c":
                    continue
                m = re.fullmatch(r"([A-Z]+)(\d+)", e.get("r", ""))
                value = next((x.text for x in e if local(x) == "v"), None)
                if e.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif e.get("t") == "inlineStr":
                    value = text_of(e)
                if m and value and value.strip():
                    col = 0
                    for ch in m[1]:
                        col = col * 26 + ord(ch) - 64
                    yield number, int(m[2]), col, value.strip()
                e.clear()


SLICE = 50_000  # cells a batch


def cells_of(files: DataFrame, kind: str) -> DataFrame:
    """Cells of files (path, content) of kind csv or xlsx; a file that cannot be parsed gives the cells up to there. Cells leave a task slice
    by slice."""
    parse = {"csv": csv_rows, "xlsx": xlsx_rows}[kind]
    names = ["file", "sheet_no", "row_no", "col_no", "value"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string()]

    def read(file: str, data: bytes) -> Iterator[tuple]:
        try:
            for cell in parse(data):
                yield (file, *cell)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError):
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in itertools.batched(read(file, data), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, CELLS)


def read_cells(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cells of the csv or xlsx files under path."""
    return cells_of(spark.read.format("binaryFile").load(path), kind)


def write_workbook(sheets: list[list[list]]) -> bytes:
    """A workbook of sheets of rows, with inline strings."""
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        for n, rows in enumerate(sheets, 1):
            cells = "".join(
                f'<row r="{i}">' + "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t>{escape(str(x))}</t></is></c>' for j, x in enumerate(row, 1) if x is not None) + "</row>" for i, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return book.getvalue()


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
