import time

import duckdb
import pandas as pd

from shelfspark.llm import line_dedup

DOCS = "doc_id long, text string"


def test_repeats_stay_once_and_boundaries_survive_insertions(spark):
    shared = [f"shared line {i}" for i in range(40)]
    a, b = "\n".join(["first", *shared, "end a"]), "\n".join(["one", "two", "three", *shared, "end b"])
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], DOCS)).collect()}
    assert out[1].n_removed == 0 and out[1].text == a
    assert out[2].n_lines == 44 and out[2].n_removed >= 25 and out[2].text.startswith("one\ntwo") and out[2].text.endswith("end b")


def test_edge_cases(spark):
    rows = [(None, "x\ny\nz"), (1, None), (2, ""), (3, "x\ny\nz"), (3, "x\ny\nz"), (4, "\n\n\n"), (5, "z" * 300_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], DOCS + ", n_lines string")
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.n_lines): r for r in out}
    assert by[None, 3].n_removed == 0  # the smallest id keeps the chunk
    assert [r.n_removed >= 2 for r in out if r.doc_id == 3] == [True, True]
    assert by[1, 0].text is None and by[2, 1].text == "" and by[5, 1].n_removed == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_same_as_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = line_dedup.dedup_lines(spark.read.parquet(path)).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = pd.DataFrame(con.sql(line_dedup.SQL).fetchall(), columns=["doc_id", "n_lines", "n_removed", "n_chunks_removed", "text"]).sort_values("doc_id", ignore_index=True)
    assert got.astype(str).values.tolist() == want[list(got.columns)].astype(str).values.tolist()


def test_many_lines_and_hot_chunks(spark, monkeypatch):
    """Linear in the lines of a text; a chunk that most texts have, and that one text has many times."""
    alike = "\n".join(f"{i % 1000}" for i in range(160_000))
    rows = [(1, alike), (2, alike)] + [(i, "\n".join(["a", "b", "c", "d", "e", "f", "g", f"own {i}"])) for i in range(3, 200)]
    docs = spark.createDataFrame(rows, DOCS)
    began = time.time()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert out[2].n_lines == 160_000 and 140_000 < out[1].n_removed < out[2].n_removed
    assert out[3].n_removed == 0 and {r.n_removed for i, r in out.items() if i > 3} == {out[4].n_removed} and out[4].n_removed > 0
    monkeypatch.setattr(line_dedup, "HOT", 1e-9)  # no chunk is hot
    assert {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()} == out
