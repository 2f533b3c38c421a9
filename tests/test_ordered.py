import random

import pytest

from shelfspark.operators.ordered import POSITION, RANGE, Fill, Number, Total, in_order, plain, ranges

SCHEMA = "g string, o int, i int, x string, y int"


def brute(rows):
    """g, i -> number, last x so far, last x before, sum of y so far."""
    out, state = {}, {}
    for g, o, i, x, y in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        n, last, total = state.get(g, (0, None, 0))
        before, last, total = last, x if x is not None else last, total + (y or 0)
        state[g] = (n + 1, last, total)
        out[g, i] = (n + 1, last, before, total)
    return out


@pytest.mark.parametrize("n", [1, 3, 16])
def test_large_and_small_groups(spark, n):
    rng = random.Random(n)
    groups = ["big"] * 300 + ["a", "b", "c", None] * 10
    rows = [(g, rng.choice([None, 1, 2, 3, 4]), i, rng.choice([None, None, None, "p", "q"]), rng.choice([None, 1, -2])) for i, g in enumerate(groups)]
    rows += [("empty", 1, 10_000 + i, None, None) for i in range(5)]
    rng.shuffle(rows)
    asks = {"n": Number(), "last": Fill("x"), "before": Fill("x", before=True), "total": Total("y")}
    got = plain(in_order(spark.createDataFrame(rows, SCHEMA), ["g"], ["o", "i"], asks, n)).collect()
    assert {(r.g, r.i): (r.n, r.last, r.before, r.total) for r in got} == brute(rows) and len(got) == len(rows)


def test_one_group_lies_in_many_ranges(spark):
    rows = spark.range(20_000).selectExpr("1 AS s", "id AS row_no", "CASE WHEN id = 0 THEN 'first' END AS x")
    placed = ranges(rows, ["s"], ["row_no"], 8)
    assert placed.groupBy(RANGE).count().agg({"count": "max"}).first()[0] < 6_000
    out = in_order(placed, ["s"], ["row_no"], {"n": Number(), "x2": Fill("x"), "sum": Total("row_no")})
    assert out.where("n <> row_no + 1 OR x2 <> 'first' OR sum <> row_no * (row_no + 1) / 2").count() == 0 and POSITION in out.columns
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_no_rows_and_no_keys(spark):
    rows = spark.createDataFrame([("a", 2, 0, None, 1), ("b", 1, 1, "p", 5)], SCHEMA)
    assert in_order(rows.limit(0), ["g"], ["o"], {"n": Number()}, 3).count() == 0
    assert [(r.o, r.n, r.t) for r in in_order(rows, [], ["o"], {"n": Number(), "t": Total("y")}, 3).orderBy("o").collect()] == [(1, 1, 5), (2, 2, 6)]
