"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its bytes and words (byte frequencies, hashed words and word
pairs, repetition, word length) by a learned tanh layer; gated attention weighs the passages of a document; a logistic unit scores the
weighted sum. Only document labels are known, so the weights of passages are learned through the bag.

The model is fitted on at most SAMPLE labelled documents of at most PASSAGES passages together, taken in the order of a hash of doc_id from
those that are not held out; a text of more than a hundredth of PASSAGES is fitted by that many of its passages, evenly spaced, so no text
takes the place of the others. Their passage features are all that reaches the driver. Scoring reads every whole text in one pass without a
shuffle.

Defined cases: null and wordless texts are one passage of zeros and are scored too; a null doc_id is not held out; repeated label rows of a
document count once (the larger label), and of rows with one doc_id one is fitted on; with no labels of both kinds every score is the share of label 1 (0.5 if there are none); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import durable
from .words import Words, chunks, mix

PASSAGE, SAMPLE, PASSAGES, HIDDEN, GATE, EPOCHS, SEED, THRESHOLD = 64, 4000, 60_000, 24, 12, 40, 7, 0.3
PAIRS = 128  # buckets of hashed words and word pairs
N_FEATURES = 256 + 4 + PAIRS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (float32), and the first passage of each text (n + 1 entries). A text has one passage at least."""
    n_words = w.counts
    n = np.maximum(-(-n_words // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    lo = np.minimum(w.first[of] + (np.arange(first[-1]) - first[of]) * PASSAGE, w.first[of + 1])
    hi = np.minimum(lo + PASSAGE, w.first[of + 1])
    out = np.zeros((len(of), N_FEATURES), np.float32)
    full = np.flatnonzero(hi > lo)
    if len(full):
        a, b = w.starts[lo[full]], w.ends[hi[full] - 1]
        size = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        counts = np.bincount(np.repeat(np.arange(len(full)), size) * 256 + w.data[at], minlength=256 * len(full)).reshape(-1, 256)
        out[full, :256] = np.sqrt(counts / size[:, None])
        h = w.hashes(lower=True)
        count = hi[full] - lo[full]
        owner = np.repeat(np.arange(len(full)), count)  # passages follow each other without gaps
        order = np.lexsort((h, owner))
        s, o = h[order], owner[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        out[full, 256] = np.bincount(o[new], minlength=len(full)) / count
        out[full, 257] = np.bincount(owner[again], minlength=len(full)) / count
        out[full, 258] = size / count / 10
        out[full, 259] = np.log1p(count) / 4
        pair = np.concatenate([mix(h[:-1] * np.uint64(3) + h[1:]), h[:0]])[owner[1:] == owner[:-1]]
        hashed = np.concatenate([h, pair]) >> np.uint64(57)
        whose = np.concatenate([owner, owner[1:][owner[1:] == owner[:-1]]])
        out[full, 260:] = np.sqrt(np.bincount(whose * PAIRS + hashed.astype(np.int64), minlength=PAIRS * len(full)).reshape(-1, PAIRS) / (2 * count[:, None]))
    return out, first


def in_parts(w: Words, size: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(first passage, features) of the passages of a chunk that is one text, `size` passages at a time: what is held of a very long text are
    its words, not its features."""
    for lo in range(0, max(len(w.starts), 1), size * PASSAGE):
        hi = min(lo + size * PASSAGE, len(w.starts))
        a, b = (w.starts[lo], w.ends[hi - 1]) if hi else (0, 0)
        yield lo // PASSAGE, passages(Words(w.rows, w.data[a:b], w.starts[lo:hi] - a, w.ends[lo:hi] - a, np.array([0, hi - lo])))[0]


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


def encode(model: dict, x: np.ndarray) -> dict:
    """Passages as learned features h, and their attention e before it is shared out in a bag."""
    x = (x - model["mean"]) / model["std"]
    h = np.tanh(x @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    return {"x": x, "h": h, "v": v, "u": u, "e": (v * u) @ model["a"]}


def pool(model: dict, h: np.ndarray, e: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags whose passages are h[first[i]:first[i + 1]]."""
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    weight = e / _sum(e, first)[bag]
    z = _sum(h * weight[:, None], first)
    return {"weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["d"], -30, 30))), "bag": bag}


def forward(model: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags whose passages are x[first[i]:first[i + 1]], with what training needs of the way there."""
    f = encode(model, x)
    return f | pool(model, f["h"], f["e"], first)


def scores(model: dict, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of passages of each text of a chunk."""
    if len(w.counts) > 1:
        x, first = passages(w)
        return np.concatenate([forward(model, x[a:b], first[i : j + 1] - a)["score"] for i, j, a, b in _blocks(first)]), np.diff(first)
    parts = [{k: f[k] for k in ("h", "e")} for _, x in in_parts(w) for f in [encode(model, x)]]
    h, e = (np.concatenate([p[k] for p in parts]) for k in ("h", "e"))
    return pool(model, h, e, np.array([0, len(e)]))["score"], np.array([len(e)])


def gradients(model: dict, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict:
    f = forward(model, x, first)
    bag, h, v, u, weight = (f[k] for k in ("bag", "h", "v", "u", "weight"))
    out = (f["score"] - label) / len(label)
    dz = out[:, None] * model["c"]
    dh = weight[:, None] * dz[bag]
    pull = (h * dz[bag]).sum(1)
    de = weight * (pull - _sum(weight * pull, first)[bag])
    dv, du = de[:, None] * model["a"] * u * (1 - v**2), de[:, None] * model["a"] * v * u * (1 - u)
    dh = (dh + dv @ model["V"].T + du @ model["U"].T) * (1 - h**2)
    return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": f["z"].T @ out, "d": out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model by Adam on shuffled batches of documents; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))
    model = {"mean": every.mean(0), "std": np.maximum(every.std(0), 0.02)}
    model |= {"W": rng.normal(0, 0.06, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "a": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(())}
    share = labels.mean() if len(labels) else 0.5
    if share in (0, 1) or not len(labels):
        return model | {"c": np.zeros(HIDDEN), "d": np.asarray(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    names = ("W", "b", "V", "U", "a", "c", "d")
    (m, s), t = ({k: np.zeros_like(model[k]) for k in names} for _ in (0, 1)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            x = np.concatenate([bags[i] for i in part])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            t += 1
            for k, g in gradients(model, x, first, labels[part]).items():
                g = g + 1e-4 * model[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model[k] = model[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _fitted(w: Words, most: int) -> list[np.ndarray]:
    """The passages of each text of a chunk; of a text of more than `most`, that many of them, evenly spaced."""
    if len(w.counts) > 1:
        x, first = passages(w)
        return [x[a:b] if b - a <= most else x[a + np.arange(most) * (b - a) // most] for a, b in zip(first, first[1:], strict=False)]
    n = max(-(-len(w.starts) // PASSAGE), 1)
    wanted = np.arange(n) if n <= most else np.arange(most) * n // most
    return [np.concatenate([x[wanted[(wanted >= a) & (wanted < a + len(x))] - a] for a, x in in_parts(w)])]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = PASSAGES, label: str = "quality") -> dict:
    """A model of labels (doc_id, `label`) over docs (doc_id, text)."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    most = max(limit // 100, 1)  # passages of one text
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(2)):
                some = _fitted(w, most)
                packed = [x.astype(np.float16).tobytes() for x in some]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(w.rows)) for i in (0, 1)] + [pa.array(list(map(len, some)), pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "label", "n", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))  # a row an id
    found = durable(one.mapInArrow(features, "doc_id long, label double, n long, x binary"), "passages")
    # whole documents in the order of the hash, as many as passages allow: first their sizes, then the features of those chosen
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sizes = found.select("n", F.row_number().over(Window.orderBy(*order)).alias("at"))  # at most `sample` rows
    last = sizes.select("at", F.sum("n").over(Window.orderBy("at")).alias("total")).where(F.col("total") <= limit).agg(F.max("at")).first()[0] or 0
    chosen = found.withColumn("at", F.row_number().over(Window.orderBy(*order))).where(F.col("at") <= last).orderBy("at").select("label", "x").toPandas()
    return fit([np.frombuffer(x, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for x in chosen["x"]], chosen["label"].to_numpy())


def score(docs: DataFrame, model: dict, keep: list[str], threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """Columns `keep` of docs, and score, predicted, n_passages of its text; a prefix keeps these apart from columns of the same names."""
    spark = docs.sparkSession
    new = [prefix + x for x in ("score", "predicted", "n_passages")]
    shared = spark.sparkContext.broadcast({k: np.asarray(v, np.float32) for k, v in model.items()})
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    # a text that is kept is sent once
    sent = keep if "text" in keep and docs.schema["text"].dataType == StringType() else [*keep, F.col("text").cast("string").alias("text ")]
    at = keep.index("text") if sent is keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(at)):
                s, n = scores(shared.value, w)
                columns = [batch.column(i).take(pa.array(w.rows)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s.astype(np.float64)), pa.array((s.astype(np.float64) >= threshold).astype(np.int32)), pa.array(n)], [*keep, *new])

    return docs.select(*sent).mapInArrow(run, f"{types}, `{new[0]}` double, `{new[1]}` int, `{new[2]}` long")


def _blocks(first: np.ndarray, size: int = 4096) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of whole bags of about `size` passages."""
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + size, "right")) - 1)
        yield i, j, int(first[i]), int(first[j])
        i = j


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def accuracy(scores: pd.DataFrame) -> dict:
    """Figures of rows (score, predicted, quality)."""
    order = scores["score"].rank()
    good = scores["quality"] == 1
    n, m = int(good.sum()), int((~good).sum())
    auc = (order[good].sum() - n * (n + 1) / 2) / max(n * m, 1)
    return {"n": len(scores), "auc": float(auc), "kept_good": float(scores[good]["predicted"].mean()), "kept_bad": float(scores[~good]["predicted"].mean())}
