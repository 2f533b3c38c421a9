import csv
import io

from pyspark.sql import functions as F

from shelfspark.operators import reports
from shelfspark.sources import sinks

SCHEMA = "session_id long, item string, q double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_rerun_replaces_its_sessions_only(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    first = [(1, "a", 1.0), (1, "a", 1.0), (2, "b", None), (None, "no session", 3.0)]
    for _ in range(2):
        sinks.write_sessions(spark.createDataFrame(first, SCHEMA), path)
    read = lambda: sinks.read_sessions(spark, path, spark.createDataFrame([], SCHEMA).schema)
    assert rows_of(read()) == sorted(first, key=str)
    sinks.write_sessions(spark.createDataFrame([(2, "new", 9.0), (3, "c", 1.0)], SCHEMA), path)
    assert rows_of(read()) == [(1, "a", 1.0), (1, "a", 1.0), (2, "new", 9.0), (3, "c", 1.0), (None, "no session", 3.0)]


def test_a_session_without_its_mark_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    sinks.write_sessions(rows, path)
    # a write that was cut short: data of session 4 and more of session 2, no mark
    spark.createDataFrame([("late", 1.0)], "item string, q double").write.parquet(f"{path}/session_id=4")
    spark.createDataFrame([("late", 1.0)], "item string, q double").write.mode("append").parquet(f"{path}/session_id=2")
    assert rows_of(sinks.read_sessions(spark, path, rows.schema)) == [(1, "a", 1.0)]
    sinks.write_sessions(spark.createDataFrame([(2, "b", 2.0), (4, "d", 4.0)], SCHEMA), path)
    assert rows_of(sinks.read_sessions(spark, path, rows.schema)) == [(1, "a", 1.0), (2, "b", 2.0), (4, "d", 4.0)]


def test_csv_files_hold_the_sheet_in_order(spark, tmp_path):
    texts = ["plain", 'say "x", y', " padded ", "two\nlines", "'=1+1", None]
    rows = spark.createDataFrame([(s, n, texts[n % 6], float(n)) for s in (1, 2) for n in range(40)], "session_id long, n int, item string, q double")
    labels = {"n": "No", "item": "Item", "q": "Qty To Order"}
    for _ in range(2):
        sinks.write_csv(rows.orderBy(F.rand(1)), f"file://{tmp_path}/sheets", labels, ["n"])
    for s in (1, 2):
        found = []
        for f in sorted((tmp_path / "sheets" / f"session_id={s}").glob("*.csv")):
            head, *lines = list(csv.reader(io.StringIO(f.read_text(), newline="")))
            assert head == list(labels.values())
            found += lines
        assert [(int(n), x or None, float(q)) for n, x, q in found] == [(n, texts[n % 6], float(n)) for n in range(40)]
    back = sinks.read_csv(spark, f"file://{tmp_path}/sheets", "n int, item string, q double, session_id long")
    assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert list(reports.LABELS.values())[-1] == "Notes"
