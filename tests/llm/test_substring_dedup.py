import hashlib

import numpy as np

from shelfspark.llm import substring_dedup as s


def planted(rng, n=60):
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 10**5, 45)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**5, rng.integers(0, 120))]
        for _ in range(rng.integers(0, 3)):
            words.insert(rng.integers(0, len(words) + 1), passages[rng.integers(0, 4)].replace(" ", "\n" if i % 3 else "  "))
        rows.append((int(i * 7 % n), " ".join(words)))
    return rows


def test_equals_brute_force_in_any_stretch(spark, monkeypatch):
    rows = planted(np.random.default_rng(6))
    rows += [(100, "ab " * 70), (101, "ab " * 70), (102, None), (103, ""), (104, rows[3][1]), (105, "é ñ " * 15)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(5)
    want = s.brute_force(rows)
    assert sum(r[2] for r in want) > 1000
    assert sorted(map(tuple, s.digest(docs).collect())) == want
    for size in (300, 5000):
        monkeypatch.setattr(s, "STRETCH", size)
        assert sorted(map(tuple, s.digest(docs).collect())) == want


def test_null_ids_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, "x " + long), (3, "w " * 100_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_words, r.n_removed) for r in s.digest(docs).collect())
    assert got == [(-1, 30, 0), (1, 30, 30), (1, 30, 30), (2, 31, 30), (3, 100_000, 99_999)]  # but its first word, all are in a repeat
    assert s.digest(docs.limit(0)).count() == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 17):
        got = s.sliding_min(x, width)
        assert all(got[i] == x[i : i + width].min() for i in range(50 - width + 1))


def test_kept_text_matches_its_digest(spark):
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in s.dedup_substrings(docs).collect()}
    assert kept == {1: "a b c", 2: ""}
    assert {r.kept_sha256 for r in s.digest(docs).collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in kept.values()}


def test_a_frequent_phrase_in_many_contexts_is_split(spark):
    """Windows around one phrase share its minimiser, but not the second one."""
    rng = np.random.default_rng(7)
    phrase = "one frequent phrase here"
    rows = [(i, " ".join([*(f"a{x}" for x in rng.integers(0, 10**6, 18)), phrase, *(f"b{x}" for x in rng.integers(0, 10**6, 18))])) for i in range(300)] + [(900, "x")]
    rows += [(500 + i, rows[i][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, s.digest(docs).collect())) == s.brute_force(rows)
    most = s.super_kmers(s.keyed(docs)).groupBy("bucket").count().groupBy().max("count").first()[0]
    assert most <= 60


def test_equal_hashes_of_different_windows_stay_apart():
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    at, whole = np.array([0, 3, 6]), np.array([7, 7, 7], np.uint64)
    assert s._repeats(whole, words, at, 3, np.array([1, 2, 3]), np.zeros(3, int)).tolist() == [False, False, False]
    assert s._repeats(whole, words, at[[0, 2, 1]], 3, np.array([1, 2, 3]), np.zeros(3, int)).tolist() == [False, True, False]
