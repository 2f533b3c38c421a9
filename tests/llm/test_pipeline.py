import corpus_pipeline as p
from shelfspark.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = p.durable(stage(spark, docs, SF))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
        if i == 0:
            good = {d for d in before if labels.get(d) == 1}
            assert len(good & after) >= 0.95 * len(good)
    assert {"doc_id", "shard", "slot"} <= set(docs.columns)


def test_nulls_clashing_columns_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, shard int, kept string, row string, copies int"
    rows = [(None, "some words of a text", None, None, None, 1, 1, "k", "r", 1), (1, None, "en", "a", 0, 1, 1, "k", "r", 1), (2, "one two three four five six", "en", "a", 0, 1, 1, "k", "r", 1), (2, "one two three four five six", "en", "a", 0, 1, 1, "k", "r", 1)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for i, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, SF)
            assert i == len(p.STAGES) - 1 or out.columns == docs.columns
            out.count()


def test_run(spark):
    assert p.run(spark, SF).count() > 50


def test_rows_with_one_id_keep_their_own_texts(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 120").first()
    rows = [(2, x, "a", 1), (3, x, "a", 2), (3, y, "b", 3), (3, y, "c", 4), (4, item.text, "a", 5), (4, x + " z " + y, "a", 6), (None, item.text, "a", 7), (None, x, "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    deduped = p.one_of_each_group(spark, docs, SF).collect()
    assert sorted(r.extra for r in deduped) == [1, 3, 5, 6, 7, 8]
    left = p.without_leaks(spark, docs, SF).collect()
    assert sorted(r.extra for r in left) == [1, 2, 3, 4, 6, 8]


def test_a_very_long_text_and_ties(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    long = spark.createDataFrame([(10_000 + i, "a b c " * 100_000, "en", "a", 1) for i in range(2)], docs.schema)
    out = docs.union(long)
    for i, (_, stage) in enumerate(p.STAGES[1:]):
        out = p.durable(stage(spark, out, SF))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert 10_001 not in ids and (i >= 2 or 10_000 in ids)


def test_a_text_of_very_many_sources_is_not_repeated_for_each(spark):
    """Each source has texts enough of its own, taken twice at most."""
    rows = [(k, "the text of all", f"s{k:02d}") for k in range(60)] + [(100 + 10 * k + i, f"only {i} of {k}", f"s{k:02d}") for k in range(60) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = p.mixed(spark, docs, SF)
    assert mixed.count() > 600 and mixed.where("text = 'the text of all'").count() <= 10


def test_a_text_without_ids_is_taken_for_the_source_that_needs_it(spark):
    """Texts in a and b, without ids: a has more than its target, b needs all of them."""
    shared = [(None, f"shared {i} x y", s) for i in range(20) for s in "ab"]
    docs = spark.createDataFrame(shared + [(i, f"only {i} of b", "b") for i in range(100)], "doc_id long, text string, source string")
    chosen, _ = mixing.mix(docs)
    want = {(r.source, r.row): r.copies for r in chosen.where("doc_id IS NULL").collect()}
    assert any(want["a", row] != want["b", row] for _, row in want)
    rows = p.mixed(spark, docs.withColumn("row", p.F.xxhash64("text")), "").where("doc_id IS NULL").groupBy("source", "row").count().collect()
    assert {(r.source, r.row): r["count"] for r in rows} == {k: n for k, n in want.items() if n}


def test_every_source_that_lacks_words_is_reached_in_one_round(spark, monkeypatch):
    """Thirty sources that lack words, one sum of each source's words a round: rounds do not follow the sources."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    monkeypatch.setattr(mixing, "ARCS", 0)
    calls, levels = [], mixing._levels

    def counted(*args):
        calls.append(args)
        assert len(calls) <= 20
        return levels(*args)

    monkeypatch.setattr(mixing, "_levels", counted)
    rows = [(None, f"text {i} of {k}", f"s{s % 30:02d}") for k in range(30) for i in range(4) for s in (k, k + 1 + i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {r.source: 4 * r["count"] for r in p.mixed(spark, docs, "").groupBy("source").count().collect()}
    want = mixing.targets([(f"s{k:02d}", 4 * sum(s == f"s{k:02d}" for _, _, s in rows)) for k in range(30)])
    assert calls and all(abs(words.get(s, 0) - n) <= 12 for s, n in want.items())
