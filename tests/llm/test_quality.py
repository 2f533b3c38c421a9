import numpy as np
import pyarrow as pa

from shelfspark.llm import quality as q
from shelfspark.llm.words import chunks

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = q.quality_digest(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    figures = q.accuracy(out[out["held_out"]])
    assert figures["n"] > 300 and figures["auc"] > 0.98 and figures["kept_good"] > 0.99 and figures["kept_bad"] < 0.1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, q.N_FEATURES)) for n in (1, 3, 5)]
    labels, x, first = np.array([1.0, 0.0, 1.0]), np.concatenate(bags), np.array([0, 1, 4, 9])
    model = q.fit(bags, labels, epochs=1)
    loss = lambda m: -np.mean(labels * np.log(s := q.forward(m, x, first)["score"]) + (1 - labels) * np.log(1 - s))
    for name, g in q.gradients(model, x, first, labels).items():
        at = tuple(0 for _ in np.shape(g))
        up, down = ({**model, name: np.array(model[name])} for _ in (0, 1))
        up[name][at] += 1e-6
        down[name][at] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - np.asarray(g)[at]) < 1e-5, name


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, " \n", 1), (3, "word " * 50_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = q.quality_digest(docs, none).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and not [r for r in out if r.doc_id is None][0].held_out
    one_kind = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in q.quality_digest(docs, one_kind).collect()} == {1}
    assert q.quality_digest(docs.limit(0), one_kind).count() == 0
    assert q.score(docs, q.fit([], np.zeros(0)), docs.columns, prefix="new ").columns == ["doc_id", "text", "score", "new score", "new predicted", "new n_passages"]


def test_same_model_every_time(spark):
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(2, q.N_FEATURES)) for _ in range(20)]
    labels = np.arange(20) % 2.0
    assert (q.fit(bags, labels)["c"] == q.fit(bags, labels)["c"]).all()


def test_one_very_long_text_leaves_the_model_as_good(spark):
    rng = np.random.default_rng(5)
    words = [[f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]]
    rows = [(i, " ".join(rng.choice(words[i % 2], 90)), i % 2) for i in range(400)]
    # the first one in the order of the sample gets more passages than the whole sample may hold
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    first = docs.where(~q.held_out(docs.doc_id)).selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").first().doc_id
    rows[first] = (first, " ".join(words[first % 2] * 96_002), first % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    found = q.quality_digest(docs, docs.select("doc_id", "quality")).join(docs.select("doc_id", "quality"), "doc_id").toPandas()
    assert q.accuracy(found[found.held_out])["auc"] > 0.95
    assert found.set_index("doc_id").n_passages[first] > 60_000


def test_a_text_in_parts_is_as_the_whole():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(50)] + ["Émile", "x" * 40]
    model = q.fit([rng.random((3, q.N_FEATURES), np.float32) for _ in range(8)], np.arange(8) % 2.0, epochs=2)
    for n in (0, 1, 63, 64, 65, 128, 1000, 6401):
        (w,) = chunks(pa.array(["  " + " ".join(rng.choice(vocabulary, n)) + "\n"]))
        whole, first = q.passages(w)
        for size in (1, 2, 7, 4096):
            parts = list(q.in_parts(w, size))
            assert [at for at, _ in parts] == list(range(0, len(whole), size))
            assert (np.concatenate([x for _, x in parts]) == whole).all()
        score, count = q.scores(model, w)
        assert count == [len(whole)] and abs(score[0] - q.forward(model, whole, first)["score"][0]) < 1e-6
        for most in (1, 10, 600):
            (some,) = q._fitted(w, most)
            assert (some == whole[np.arange(len(whole)) if len(whole) <= most else np.arange(most) * len(whole) // most]).all()
