import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import convert

TODAY = "2026-07-26"


def run(spark, grid, today=TODAY, first_month=1, **recipe):
    """grid: rows of (item, months..., supplier, lead) below a header in row 2. Recipe fields override the right one."""
    width = len(grid[0])
    months = width - 3
    cells = [(7, 2, c, f"h{c}") for c in range(1, width + 1)]
    cells += [(7, 3 + i, c + 1, str(v)) for i, row in enumerate(grid) for c, v in enumerate(row) if v not in (None, "")]
    fields = {"layout": "wide_matrix", "header_row": 2, "item_col": 1, "month_cols": {c + 2: first_month + c for c in range(months)}, "supplier_col": months + 2, "leadtime_col": months + 3, "n_rows": len(grid) + 2, "n_cols": width} | recipe
    schema = "file long, layout string, header_row int, item_col int, month_cols map<int,int>, supplier_col int, leadtime_col int, n_rows int, n_cols int"
    recipes = spark.createDataFrame([(7, *fields.values())], schema)
    out = convert.convert(spark.createDataFrame(cells, "file long, row_no long, col_no int, value string"), recipes, F.lit(today).cast("date"))
    rows = sorted((r["item"], r.date.month, r.qty, r.supplier, r.lead_days) for r in out.rows.collect())
    return out.readback.first(), rows, out


def varied(n, months, low=10):
    return [[f"item {i}", *[low + (i * 7 + m * 3) % 11 for m in range(months)], "", ""] for i in range(n)]


def test_plain_grid(spark):
    grid = varied(4, 6)
    grid[0][7:], grid[2][7:] = ["Acme", "10 WEEKS"], ["Beta", ""]
    grid += [["TOTAL", *[999] * 6, "", ""], ["", *[5] * 6, "Gamma", "2 MONTHS"], ["item 9", 0, "1,200", None, None, "0", 3, "Beta", "soon"]]
    back, rows, out = run(spark, grid)
    assert (back.outcome, back.reason, back["items"], back.months_kept, back.months_dropped, back.assumed_year, back.question) == ("confident", None, 5, [1, 2, 3, 4, 5, 6], [], 2026, None)
    assert back.total_units == sum(sum(r[1:7]) for r in varied(4, 6)) + 1203
    assert {(i, s, d) for i, _, _, s, d in rows} == {("item 0", "Acme", 70), ("item 1", "Acme", 70), ("item 2", "Beta", None), ("item 3", "Beta", None), ("item 9", "Beta", None)}
    assert [(m, q) for i, m, q, _, _ in rows if i == "item 9"] == [(1, 0), (2, 1200), (5, 0), (6, 3)]
    assert out.rows.first().date.day == 15


def test_a_month_of_texts_refuses_the_file(spark):
    grid = varied(3, 6)
    for r in grid:
        r[3] = "see note"
    back, rows, _ = run(spark, grid)
    assert (back.outcome, back.reason, back["items"], rows) == ("refused", "the column of March holds texts, no quantities", None, [])


def test_some_texts_degrade_it(spark):
    grid = varied(5, 6)
    grid[0][3] = "n/a"
    back, rows, _ = run(spark, grid)
    assert back.outcome == "degraded" and "March" in back.question and len(rows) == 29
    grid += varied(20, 6)  # a text in 25: below a fifth
    assert run(spark, grid)[0].outcome == "confident"


def test_flat_tail_goes_and_a_borderline_month_stays(spark):
    grid = varied(20, 12)
    for i, r in enumerate(grid):
        r[9:13] = [50 + i] * 4  # from September on
    back, rows, _ = run(spark, grid)
    assert (back.outcome, back.months_kept, back.months_dropped, back.assumed_year) == ("confident", list(range(1, 9)), [9, 10, 11, 12], 2025)
    for r in grid[:3]:
        r[9] += 5  # three of twenty disagree
    back, rows, _ = run(spark, grid)
    assert (back.outcome, back.months_kept, back.months_dropped) == ("degraded", list(range(1, 10)), [10, 11, 12]) and "September" in back.question
    assert len(rows) == 20 * 9


def test_empty_months_are_left_out(spark):
    grid = varied(4, 8)
    for r in grid:
        r[4], r[8] = "", ""
    back, rows, _ = run(spark, grid)
    assert (back.outcome, back.months_kept, back.months_dropped) == ("confident", [1, 2, 3, 5, 6, 7], [4, 8])
    # a flat tail across an empty month is still one
    for i, r in enumerate(grid):
        r[5:8] = [30 + i, "", 30 + i]
    assert run(spark, grid)[0].months_dropped == [4, 5, 6, 7, 8]


@pytest.mark.parametrize(("values", "dropped"), [([7, 7, 0], []), ([0, 7, 7], [5, 6]), ([7, 7, 7], [4, 5, 6])])
def test_zeros_in_a_tail(spark, values, dropped):
    grid = varied(4, 6)
    for r in grid:
        r[4:7] = values
    assert run(spark, grid)[0].months_dropped == dropped


def test_refusals(spark):
    assert run(spark, varied(2, 6), item_col=40)[0].reason == "item column out of bounds"
    back, rows, _ = run(spark, [["item", "", "", "", "", "", "", "", ""]])
    assert (back.outcome, back.reason, rows) == ("refused", "no month has a number", [])
    back, rows, out = run(spark, varied(2, 6), supplier_col=None, leadtime_col=None)
    assert back.outcome == "confident" and {r[3:] for r in rows} == {(None, None)}


def test_year(spark):
    assert run(spark, varied(3, 6), first_month=7)[0].assumed_year == 2025
    assert run(spark, varied(3, 6), first_month=7, today="2026-12-01")[2].rows.agg(F.max("date")).first()[0] == datetime.date(2026, 12, 15)
