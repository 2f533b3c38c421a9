import pytest
from pyspark.sql import functions as F

from shelfspark.operators import velocity
from shelfspark.operators.kept import Kept
from shelfspark.plans import kept_queries

ROWS = "session_id long, item string, q double, `write rows` string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def pair(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    sums = spark.createDataFrame([], "session_id long, item string, q double").schema
    return Kept(spark, f"file://{tmp_path}/source", schema).create(), Kept(spark, f"file://{tmp_path}/sums", sums).create()


def add_up(rows):
    return rows.groupBy("session_id", "item").agg(F.sum("q").alias("q"))


def put(spark, table, batch, rows):
    table.append(spark.createDataFrame([(*r, None) for r in rows], ROWS), batch)


def test_empty_tables(pair):
    source, sums = pair
    assert rows_of(source.rows()) == rows_of(sums.rows()) == rows_of(sums.refresh(source, add_up)) == rows_of(sums.changes(["session_id", "item"])) == []
    source.create()  # stays as it is


def test_batches_add_up_and_a_rerun_replaces(spark, pair):
    source, sums = pair
    first = [(1, "a", 1.0), (1, "a", 1.0), (1, None, None), (2, "b", 2.0), (None, "no session", 9.0)]
    put(spark, source, "one", first)
    assert {s for s, _ in rows_of(sums.refresh(source, add_up))} == {1, 2}
    put(spark, source, "one", first)  # the same again
    assert rows_of(sums.refresh(source, add_up)) == []
    put(spark, source, "two", [(2, "b", 5.0), (3, "c", 1.0)])
    assert {s for s, _ in rows_of(sums.refresh(source, add_up))} == {2, 3}
    assert rows_of(sums.rows()) == [(1, "a", 2.0), (1, None, None), (2, "b", 7.0), (3, "c", 1.0)]
    assert rows_of(sums.changes(["session_id", "item"]).select("session_id", "item", "change", "before.q", "after.q")) == [(2, "b", "changed", 2.0, 7.0), (3, "c", "added", None, 1.0)]
    put(spark, source, "one", [(1, "a", 4.0)])  # corrected: session 2 has lost its rows of this file
    assert {s for s, _ in rows_of(sums.refresh(source, add_up))} == {1, 2}
    assert rows_of(sums.rows()) == [(1, "a", 4.0), (2, "b", 5.0), (3, "c", 1.0)]
    put(spark, source, "two", [])
    assert {(s, v) for s, v in rows_of(sums.refresh(source, add_up))} == {(2, None), (3, None)}
    assert rows_of(sums.rows()) == [(1, "a", 4.0)] and rows_of(sums.refresh(source, add_up)) == []
    assert rows_of(sums.changes(["session_id", "item"]).select("session_id", "change")) == [(2, "removed"), (3, "removed")]
    assert rows_of(sums.n_refreshed()) == [(1, 2), (2, 4), (3, 2)]


def test_only_sessions_that_changed_are_read(spark, pair, tmp_path):
    source, sums = pair
    put(spark, source, "one", [(s, f"item {s}", 1.0) for s in range(20)])
    sums.refresh(source, add_up)
    spoilt = list((tmp_path / "source" / "rows").glob("write=*/session_id=*/*.parquet"))
    assert len(spoilt) == 20
    for f in spoilt:
        f.write_bytes(b"not a table")
    for f in (tmp_path / "source" / "rows").glob("write=*/session_id=*/.*.crc"):
        f.unlink()
    put(spark, source, "two", [(100, "new", 1.0)])
    assert [s for s, _ in rows_of(sums.refresh(source, add_up))] == [100]
    assert len(rows_of(sums.rows())) == 21


def test_a_write_without_its_mark_is_not_read(spark, pair, tmp_path):
    source, sums = pair
    put(spark, source, "one", [(1, "a", 1.0)])
    before = set((tmp_path / "source" / "marks").iterdir())
    put(spark, source, "two", [(1, "a", 5.0), (2, "b", 1.0)])
    for mark in set((tmp_path / "source" / "marks").iterdir()) - before:  # as if the write had been cut short
        mark.rename(tmp_path / mark.name)
    assert rows_of(source.rows().select("session_id", "item", "q")) == [(1, "a", 1.0)]
    put(spark, source, "two", [(1, "a", 5.0), (2, "b", 1.0)])
    sums.refresh(source, add_up)
    assert rows_of(sums.rows()) == [(1, "a", 6.0), (2, "b", 1.0)]


def test_a_new_file_can_turn_the_dates_of_its_session(spark, tmp_path):
    columns = "session_id long, item_raw string, item_no long, date_raw string, qty_raw string, rev_raw string, avg_raw string"
    line = lambda s, date: (s, "Tea", 1, date, "2", "$1.50", "")
    first, later = [line(1, "03/04/2021"), line(2, "03/04/2021")], [line(1, "04/25/2021")]  # a 25 in second place: months come first
    sales = spark.createDataFrame(first, columns)
    kept = kept_queries.tables(spark, f"file://{tmp_path}/kept", sales)
    kept[0].append(velocity.by_date(sales), "first")
    kept_queries.refresh(*kept)
    month = lambda: {r["session_id"]: sorted(str(x["month"])[:7] for x in kept[1].rows().where(F.col("session_id") == r["session_id"]).collect()) for r in kept[1].rows().select("session_id").distinct().collect()}
    assert month() == {1: ["2021-04"], 2: ["2021-04"]}
    kept[0].append(velocity.by_date(spark.createDataFrame(later, columns)), "later")
    assert [s for s, _ in rows_of(kept_queries.refresh(*kept))] == [1]
    assert month() == {1: ["2021-03", "2021-04"], 2: ["2021-04"]}
    whole = velocity.sales_cube(spark.createDataFrame(first + later, columns))
    assert rows_of(kept[1].rows()) == rows_of(whole.select(*kept[1].schema.names))
