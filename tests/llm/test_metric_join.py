import numpy as np
import pytest

from shelfspark.llm import metric_join as m


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.25, size=8)]) for i in range(240)]
    rows += [(1000 + i, rows[5][1]) for i in range(4)] + [(2000, [2 * x for x in rows[5][1]])]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [1.0, None] + [0.0] * 6), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted(tuple(r) for r in m.near_vectors(df, n_pivots=9, block=block, slice_=2 * block).collect())
    assert got == m.brute_force(rows)


def test_empty_null_and_repeated_ids(spark):
    kind = "vec_id long, embedding array<float>"
    assert m.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = m.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], kind)).collect()
    assert sorted((r.vec_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_scaled_copies_as_pivots(spark, kind):
    rng = np.random.default_rng(4)
    one, far = rng.normal(size=(2, 64))
    rows = [(i, [float(x) for x in one * rng.uniform(0.1, 10)]) for i in range(600)] + [(1000 + i, [float(x) for x in far * rng.uniform(0.1, 10)]) for i in range(5)]
    got = m.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), n_pivots=21).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 1000} == {(599, 0)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id >= 1000} == {(4, 1000)}


def test_copies_meet_in_each_others_cells_without_merging(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=64)
    x = np.stack([m._matrix(m.pa.array([(v / np.sqrt(v @ v)).tobytes()]))[0] for v in (one * rng.uniform(0.1, 10, (40, 1)))])
    share = spark.sparkContext.broadcast
    reps = spark.createDataFrame([(i, 64, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id long, size int, unit binary, copies long")
    pivots = share({64: x[:9]})
    assert m.dealt(m.at_home(reps, pivots), pivots, share({64: np.zeros(9)}), 0.4).count() == 40 * 9


def test_radius_rules_out_tight_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64))
    rows = [(i, [float(v) for v in centres[i % 8] + rng.normal(scale=0.05, size=64)]) for i in range(160)]
    units = m.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    share, x = spark.sparkContext.broadcast, np.stack([np.frombuffer(r.unit, float) for r in sorted(units, key=lambda r: r.vec_id)])
    pivots = share({64: x[:8]})
    homes = m.at_home(spark.createDataFrame([(i, 64, bytearray(v.tobytes()), 1) for i, v in enumerate(x)], "id long, size int, unit binary, copies long"), pivots)
    radii = np.array([r[1] for r in sorted(homes.groupBy("cell").max("near").collect())])
    assert m.dealt(homes, pivots, share({64: radii}), 0.4472).count() == 160
    noise = rng.normal(size=(40, 64))
    noise = [(1000 + i, 64, bytearray((v / np.sqrt(v @ v)).tobytes()), 1) for i, v in enumerate(noise)]
    far = m.at_home(spark.createDataFrame(noise, "id long, size int, unit binary, copies long"), pivots)
    assert m.dealt(far, pivots, share({64: radii}), 0.4472).count() == 40 < m.dealt(far, pivots, share({64: radii + 9}), 0.4472).count()


def test_many_lengths(spark):
    rows = [(i, [float(j + 1) for j in range(1 + i // 2)]) for i in range(400)]
    got = m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), n_pivots=3).collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id // 2 * 2) for r in got)


def test_no_vector_is_copied_for_the_cells_it_meets(spark, monkeypatch):
    """Evenly spread vectors meet every cell; what is written and shuffled stays in proportion to them."""
    written, write = {}, m.durable
    monkeypatch.setattr(m, "durable", lambda df, name: written.setdefault(name, write(df, name)))
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(800)]
    got = m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), n_pivots=20, block=50)
    assert sorted(tuple(r) for r in got.collect()) == m.brute_force(rows)
    assert "cells" not in written
    blocks = written["blocks"].collect()
    assert sum(len(r.ids) // 8 for r in blocks) == 800 and max(len(r.meets) for r in blocks) == 20
    pivots = spark.sparkContext.broadcast({64: np.eye(64)[:1]})
    plan = m.joined(written["blocks"], pivots, spark.sparkContext.broadcast({64: np.ones(1)}), 0.4472, 0.9, 50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
