import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import hilbert_shards as h


@pytest.mark.parametrize(("order", "dims"), [(2, 2), (3, 2), (2, 3), (1, 4)])
def test_curve_visits_each_cell_by_single_steps(spark, order, dims):
    cells = spark.range(1 << (order * dims)).select(*[F.shiftrightunsigned("id", order * j).bitwiseAND((1 << order) - 1).cast("int").alias(f"c{j}") for j in range(dims)])
    rows = cells.withColumn("h", h.hilbert_index([F.col(f"c{j}") for j in range(dims)], order)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (order * dims)))
    assert all(sum(abs(a[j] - b[j]) for j in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_sizes_slots_and_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = h.shard_digest(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    total, per = sum(r.size for r in rows), {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        per.setdefault(r.shard, []).append(r)
    assert sorted(per) == list(range(8))
    for shard in per.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r.size for r in shard) - total / 8) < total / 8 / 20
    home = {}
    assert all(home.setdefault(texts[r.doc_id], r.shard) == r.shard for r in rows)


def test_large_groups_stay_whole_and_shards_equal(spark):
    """Groups of 5 % to a whole share; one that no shard could hold is cut."""
    rows = [(i, f"{i} " + "w" * 90, "a", "en") for i in range(2000)]
    for g, copies in enumerate((900, 600, 500, 300, 100, 100, 3000)):
        rows += [(10_000 * (g + 1) + i, f"{g} copy " + "c" * 90, f"s{i % 5}", "en") for i in range(copies)]
    got = h.shard_digest(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    share = sum(r.size for r in got) / 8
    sizes, homes = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(abs(sizes[s] - share) < share / 8 for s in range(8))
    cut = [c for c, s in homes.items() if len(s) > 1]
    assert len(cut) == 1 and cut == [zlib.crc32(("6 copy " + "c" * 90).encode())]
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_edge_cases(spark):
    kind = "doc_id long, text string, source string, lang string, shard string, size string"
    rows = [(None, None, None, None), (1, None, "a", "en"), (2, "", None, "en"), (3, "same", "a", None), (3, "same", "a", None), *[(i, "hot copy", f"s{i % 3}", "en") for i in range(10, 60)], (99, "x" * 500_000, "a", "en")]
    got = h.shard_digest(spark.createDataFrame([(*r, "q", "q") for r in rows], kind)).collect()
    assert len(got) == len(rows) and {r.shard for r in got} <= set(range(8))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert h.shard_digest(spark.createDataFrame([], kind)).count() == 0
