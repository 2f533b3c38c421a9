"""CSV files of any size as cells: a file is read by lines in many tasks, and quoted cells may run over lines and over the borders of tasks.

Whether a line begins inside a quoted cell depends on all lines before it. Each line is read for both cases, which tells how it leaves them:
it keeps them, swaps them, or ends in one state either way. The state before a line follows from the last line of the third kind and the
number of swaps since, so a running sum and a fill over ranges of lines give it for all lines at once.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.ordered import Fill, Number, Total, in_order, plain

from .files import SLICE, delimiter_of

SAMPLE = 8192
PLACE = ["start", "line_id"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), line_id (rising inside a split), line: without its line end; bytes that are no UTF-8 become U+FFFD."""
    lines = spark.read.option("lineSep", "\n").text(path)
    first = (F.col("start") == 0) & F.col("line").startswith("﻿")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line_id"), F.make_valid_utf8("value").alias("line"))
    return lines.withColumn("line", F.when(first, F.substring("line", 2, 2**31 - 1)).otherwise(F.col("line")))


def delimiters(lines: DataFrame) -> DataFrame:
    """file, sep: sniffed from the first SAMPLE characters of each file."""
    size = lines.withColumn("size", F.length("line") + 1)
    head = in_order(size, ["file"], PLACE, {"end": Total("size")}).where(F.col("end") - F.col("size") < SAMPLE)
    text = head.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*PLACE, F.substring("line", 1, SAMPLE).alias("line")))).alias("x"))
    sniff = F.pandas_udf(lambda s: s.map(lambda x: delimiter_of(x[:SAMPLE])), "string")
    return text.select("file", sniff(F.concat(F.array_join("x.line", "\n"), F.lit("\n"))).alias("sep"))


def leaves_quoted(line: str, sep: str, quoted: bool) -> bool:
    """Whether a line that begins inside a quoted cell (or not) ends inside one. A quote opens a cell at its very beginning only."""
    i, n, begins = 0, len(line), not quoted
    while i < n:
        if quoted:
            end = line.find('"', i)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == '"':
                i = end + 2
            else:
                i, quoted, begins = end + 1, False, False
        elif begins and line[i] == '"':
            i, quoted, begins = i + 1, True, False
        else:
            end = line.find(sep, i)
            if end < 0:
                return False
            i, begins = end + 1, True
    return quoted


def _turns(line: pd.Series, sep: pd.Series) -> pd.DataFrame:
    """swap: 1 if a line exchanges the two states; fixed: the state it ends in either way."""
    swap, fixed = [], []
    for x, s in zip(line, sep, strict=True):
        out, inside = (False, True) if '"' not in x else (leaves_quoted(x, s, False), leaves_quoted(x, s, True))
        swap.append(int(out and not inside))
        fixed.append(out if out == inside else None)
    return pd.DataFrame({"swap": swap, "fixed": pd.Series(fixed, dtype=object)})


def records(lines: DataFrame) -> DataFrame:
    """file, record (rising in a file), sep, text: lines put together to records."""
    turned = lines.join(delimiters(lines), "file").withColumn("turn", F.pandas_udf(_turns, "struct<swap:int, fixed:boolean>")("line", "sep")).select("file", *PLACE, "sep", "line", "turn.swap", "turn.fixed")
    summed = plain(in_order(turned, ["file"], PLACE, {"swaps": Total("swap")}))
    anchor = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps"))
    held = plain(in_order(summed.withColumn("anchor", anchor), ["file"], PLACE, {"last": Fill("anchor", before=True)}))
    since = F.col("swaps") - F.col("swap") - F.coalesce(F.col("last")["swaps"], F.lit(0))
    quoted = F.coalesce(F.col("last")["fixed"], F.lit(False)).cast("int").cast("bigint")
    inside = (since + quoted) % 2 == 1
    begun = plain(in_order(held.withColumn("begins", (~inside).cast("int")), ["file"], PLACE, {"record": Total("begins")}))
    parts = F.array_sort(F.collect_list(F.struct(*PLACE, "line")))
    return begun.groupBy("file", "record").agg(F.first("sep").alias("sep"), F.array_join(parts["line"], "\n").alias("text"))


def large_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no, col_no, value: the cells of the CSV files under path, as the reader of whole files gives them: blank cells and blank rows
    are left out, cells are trimmed. Memory follows one record, not the file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            rows = []
            for file, record, sep, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = next(csv.reader(io.StringIO(text.removesuffix("\r")), delimiter=sep), [])
                rows += [(file, record, c, x.strip()) for c, x in enumerate(cells, 1) if x.strip()]
                if len(rows) >= SLICE:
                    yield _cells(rows)
                    rows = []
            yield _cells(rows)

    found = records(read_lines(spark, path)).select("file", "record", "sep", "text").mapInArrow(parse, "file string, record long, col_no int, value string")
    at = found.select("file", "record").distinct()
    numbers = plain(in_order(at, ["file"], ["record"], {"row_no": Number()}))
    return found.join(numbers, ["file", "record"]).select("file", "row_no", "col_no", "value")


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "record", "col_no", "value"])
