import math
import random

import numpy as np
import pytest

from shelfspark.llm import code_search as c

SCHEMA = "vec_id long, label int, embedding array<double>, code string"


def check(spark, rows, **options):
    out, books = c.compress(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), **options)
    got = [(r.vec_id, r.label, list(r.code), r.error) for r in out.collect()]
    want, want_books = c.brute_force(rows, **options)
    assert sorted(got, key=str) == sorted(((i, None if lab is None else str(lab), code, e) for i, lab, code, e in want), key=str)
    if want:
        assert books.tolist() == want_books
    totals = {}
    for _, lab, _, e in want:
        totals[lab] = totals.get(lab, 0) + e
    assert {r.label: r.label_error for r in out.collect()} == {None if k is None else str(k): min(v, 2**63 - 1) for k, v in totals.items()}
    return got


@pytest.mark.parametrize("spread", [0.02, 1, 50])
def test_equals_brute_force(spark, spread):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, None]), [rng.gauss(0, spread) for _ in range(12)]) for i in range(150)]
    rows += [(i + 200, 0, rows[7][2]) for i in range(60)]  # copies
    check(spark, rows, parts=4, entries=9)


def test_odd_rows(spark):
    rows = [(1, 0, [0.5] * 32), (2, None, None), (3, 1, [math.nan] * 32), (4, 1, [1.0, None]), (5, 1, [math.inf] * 32), (6, None, []), (7, None, [0.1] * 5), (8, 2, [-0.001] * 40), (None, 2, [0.2] * 32), (1, 0, [0.5] * 32), (1, 0, [-0.5] * 32)]
    got = check(spark, rows)
    assert len(got) == 7
    check(spark, rows, entries=2)
    check(spark, [(6, None, []), (7, 1, [])])
    check(spark, [(2, None, None)])
    check(spark, [])


def test_huge_components_are_exact(spark):
    rows = [(i, i % 3, [s * x] * 16) for i, (s, x) in enumerate((s, x) for s in (1, -1) for x in (0.3, 5e6, 2.0**33, 1e300, 1.7e308))]
    check(spark, rows, entries=3)
    check(spark, [(i, 0, [i * 2.0**20 + j for j in range(16)]) for i in range(40)], entries=5)


def test_search_stops_early_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(2)
    book = c.Codebook(rng.integers(-300, 300, (64, 4)))
    x = rng.integers(-300, 300, (500, 4))
    index, far, tried = book.nearest(x)
    all_far = ((x[:, None] - book.entries) ** 2).sum(axis=2)
    assert (index == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    assert tried < 0.7 * all_far.size
    same = c.Codebook(np.array([[3, 1], [1, 3], [2, 2], [1, 3]]))
    assert same.nearest(np.array([[2, 2], [1, 3], [0, 0], [9, 9]]))[0].tolist() == [2, 1, 2, 2]
    # an entry at exactly the bound is still looked at: (0, 0) is as near as (2, 2) to (1, 1), and comes first
    assert c.Codebook(np.array([[0, 0], [2, 2]])).nearest(np.array([[1, 1]]))[0].tolist() == [0]
