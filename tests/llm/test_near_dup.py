import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import near_dup as n
from shelfspark.llm.components import connected


def brute(rows, k=5):
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i != j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {x: a if g == b else g for x, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in sets}


def variants(rng, n, words, edits):
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            t[at] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("k", "edits"), [(2, 20), (5, 8)])
def test_components_equal_all_pairs(spark, k, edits):
    """Groups in which about half of the pairs link, so a leader alone would not join them."""
    rng = np.random.default_rng(k)
    texts = [t for size, words in ((120, 150), (60, 60), (20, 12), (10, 7)) for t in variants(rng, size, words, edits * words // 150 + 1)]
    texts += [" ".join(f"u{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(60)] + ["a b", "A  B", "a", "", None, "a b c d e"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
    assert got == brute(rows, k)


def test_edge_cases(spark):
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (2, "ONE two\nthree four five six"), (4, None), (5, ""), (6, "x " * 200_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in n.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (4, 4, True), (5, 5, True), (6, 6, True)]
    assert n.near_duplicates(docs.limit(0)).count() == 0


def test_equal_ids_with_different_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(2, x), (3, x), (3, y), (3, y), (4, z), (4, z + " more"), (5, y), (5, "")]
    got = [(r.doc_id, r.row, r.component_id, r.kept, r.first, r.copies) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    row = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "xxhash64(t)").collect()}
    small = min((z, z + " more"), key=lambda t: row[t])
    want = [(2, row[x], 2, True, True, 1), (3, row[x], 2, False, False, 1)] + [(3, row[y], 3, True, True, 2)] * 2 + [(5, row[y], 3, False, False, 1), (5, row[""], 5, True, True, 1)]
    want += [(4, row[t], 4, True, t == small, 1) for t in (z, z + " more")]
    assert sorted(got) == sorted(want)


def test_blocks_cut_by_bytes(spark):
    rng = np.random.default_rng(9)
    rows = list(enumerate(variants(rng, 60, 100, 12)))
    want = brute(rows)
    for block, size in ((256, 8_000_000), (3, 8_000_000), (256, 500)):
        sets = n._sets(spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, row long, text string"), spark.createDataFrame([(i, i, i, 1) for i, _ in rows], "id long, doc_id long, row long, copies long"), 5)
        links = n.compare_blocks(spark.createDataFrame([(-1, i, i, 96) for i, _ in rows], "main long, id long, component long, n long"), sets, 80, block, size)
        component = {r.id: r.component for r in connected(links).collect()}
        assert {i: component.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()}


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
        both = int(share * 3000)
        a, b = np.unique(pool[:3000]), np.unique(np.concatenate([pool[:both], pool[3000 : 6000 - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(n.estimate(n.registers(a), n.registers(b), len(a), len(b)) - true) < 0.12


def test_short_sets_fill_all_registers():
    ((_, s),) = n.shingle_sets(pa.array(["only one"]), 2)
    assert len(s) == 1 and len(set(n.registers(s).tolist())) == 1


def test_same_as_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, n.digest(spark.read.parquet(path)).collect())) == sorted(con.sql(n.SQL).fetchall())


def test_connected(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(map(int, x)) for x in rng.integers(200, 300, (60, 2))]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
