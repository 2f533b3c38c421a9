import hashlib
import random

import numpy as np
import pytest

from shelfspark.llm import fill_middle as f

RNG = random.Random(7)
TEXTS = [None, "", "a", "abc", "é", "one two", "x<P>y", "<M>", "<S", "P> and <", "ab" * 90_000, "日本😀é " * 4000, "Ein Täg\n\n12"] + ["".join(RNG.choice(["a", "Bc", " ", "é", "日", "😀", "<", "P>", "S>", "\n", "1"]) for _ in range(RNG.randint(0, 30))) for _ in range(300)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (5, "one two"), (5, "one two")]


def sorted_rows(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("unit", ["tokens", "chars"])
def test_equals_brute_force_and_restores(spark, unit, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS], "doc_id long, text string, n int, form string")
    out = f.fill_in_middle(docs, unit=unit)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted_rows(got) == sorted_rows(f.brute_force(ROWS, unit))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = [tuple(r) for r in out.select("doc_id", f.restored().alias("text")).collect()]
    assert sorted_rows(back) == sorted_rows([(i, t or "") for i, t in ROWS])
    for r in out.where("form <> 'plain'").collect():
        text = dict(ROWS)[r.doc_id]
        assert len(text[: r.prefix_chars].encode()) == r.prefix_bytes
        assert len(text[r.prefix_chars : r.prefix_chars + r.middle_chars].encode()) == r.middle_bytes
    assert f.fill_in_middle(docs.limit(0), unit=unit).count() == 0


def test_digest(spark):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*r[:5], sha(r[5]), sha(dict(ROWS)[r[0]] or "")) for r in f.brute_force(ROWS)]
    assert sorted_rows(map(tuple, f.digest(docs).collect())) == sorted_rows(want)


def test_index_is_sparse_and_converts_both_ways():
    for text in ["", "abc", "é", "aé日😀b", "日本" * 50 + "a" * 1000 + "é"]:
        raw = text.encode()
        index = f.Exceptions(np.frombuffer(raw, np.uint8))
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        chars = np.arange(len(text) + 1)
        places = np.array([len(text[:c].encode()) for c in chars])
        assert (index.bytes(chars) == places).all() and (index.chars(places) == chars).all()


def test_own_sentinels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    own = ("[pre]", "[suf]", "[mid]")
    back = f.fill_in_middle(docs, sentinels=own, rate=100, spm=50, seed=3).select("doc_id", "form", f.restored(sentinels=own).alias("text")).collect()
    assert sorted_rows((r.doc_id, r.text) for r in back) == sorted_rows([(i, t or "") for i, t in ROWS])
    for bad in (("aba", "x", "y"), ("ab", "bc", "y"), ("", "x", "y")):
        with pytest.raises(ValueError):
            f.fill_in_middle(docs, sentinels=bad)
