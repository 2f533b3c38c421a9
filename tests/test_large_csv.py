import csv
import io
import random

import pytest

from shelfspark.sources import files
from shelfspark.sources.large_csv import large_csv_cells, leaves_quoted


def cells_by_file(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = {}
        for r in large_csv_cells(spark, f"file://{folder}").collect():
            out.setdefault(r.file.rsplit("/", 1)[1], set()).add((1, r.row_no, r.col_no, r.value))
        return out
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quotes_over_lines_and_splits(spark, tmp_path):
    rng = random.Random(2)
    texts = {}
    for name, sep in (("a.csv", ","), ("b.csv", ";"), ("c.csv", "\t")):
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=sep, lineterminator="\r\n" if name == "b.csv" else "\n")
        w.writerow(["key", "name", "note"])
        for i in range(60):
            w.writerow([i, rng.choice(["x", f"a{sep}b", 'say "x"', "two\nlines", '"', ' "not quoted" ', "", "é"]), rng.choice(["", "l1\n\n\"l3\"\nl4", f"{sep}{sep}", "plain"])])
        texts[name] = out.getvalue()
    texts["d.csv"] = "﻿k,v\n1,bad \"quote\" inside\n\n2,'x'\n3,\"open to the end\nof the file"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode() if name != "c.csv" else text.encode() + b"99\t\xff\xfe\tx\n")
    want = {name: set(files.csv_rows((tmp_path / name).read_bytes())) for name in texts}
    assert cells_by_file(spark, tmp_path, "128m") == want
    assert cells_by_file(spark, tmp_path, "100b") == want


def test_a_large_cell_and_an_empty_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text(f'a,b\n1,"{"x" * 200_000}"\n')
    (tmp_path / "empty.csv").write_text("")
    assert cells_by_file(spark, tmp_path, "1k") == {"big.csv": {(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "1"), (1, 2, 2, "x" * 200_000)}}


@pytest.mark.parametrize(("line", "ends"), [("a,b", (False, True)), ('"a', (True, False)), ('a","b', (True, True)), ('x"', (False, False)), ('a"b', (False, False)), ('"a""', (True, False)), ('"a","b"', (False, False)), ("", (False, True))])
def test_how_a_line_leaves_both_states(line, ends):
    assert (leaves_quoted(line, ",", False), leaves_quoted(line, ",", True)) == ends
