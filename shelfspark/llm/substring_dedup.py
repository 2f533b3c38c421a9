"""Substring dedup by super-k-mers.

A window is K consecutive words of one text. A window's minimisers are the smallest hashes among its runs of M words in two orders of the
hashes, so equal windows have equal minimisers, and a frequent run of M words does not make one large bucket: the second minimiser splits it.
Consecutive windows with the same two travel together, as the one stretch of text that holds them (a super-k-mer), to the bucket of the two,
where sorting brings equal windows together; all but the earliest (smallest doc_id, then start) are repeats, and every word that a repeat
covers is removed.

Two steps before that keep the traffic down and lose nothing. Each task sorts the windows of a few megabytes of text and passes on only the
first of equal windows, so a passage of a third of all documents arrives once for each such stretch, not once for each document. Then a
census of minimisers, without texts, leaves only super-k-mers whose minimiser occurs in another one: a window alone in its bucket cannot
have an equal.

Windows are sorted by a hash of their words; those of one hash are then compared word by word.

Defined cases: null text has no words; texts with fewer than K words keep all of them; a null doc_id counts as the smallest; windows at the
same (doc_id, start) of repeated rows are one occurrence, so exact repeats of a row are treated alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions
from .words import chunks, mix, window_hashes

K, M = 20, 4
STRETCH = 1_000_000  # bytes of text that a task sorts at once
_NO_ID = -(2**63)
_PLACES = ["bucket", "doc_id", "row", "start", "n", "known"]
_PACKED = ["bucket", "doc_id", "row", "start", "packed"]
_FOUND = ["doc_id", "row", "start", "n"]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i:i + width] for each i; the last width - 1 places are shorter."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.concatenate([np.minimum(out[:-step], out[step:]), out[-step:]]) if len(out) > step else out
        have += step
    return out


def _runs(words: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch in which words go up by one and same does not change."""
    if not len(words):
        return words, words
    first = np.flatnonzero(np.concatenate([[True], (np.diff(words) != 1) | (same[1:] != same[:-1])]))
    return first, np.diff(np.append(first, len(words)))


def _repeats(whole: np.ndarray, words: np.ndarray, at: np.ndarray, k: int, doc: np.ndarray, start: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """Marks every window that equals an earlier one, given ascending (doc, start). whole: a hash of each window; words: one number for each
    different word of the text; at: the first word of each window."""
    order = np.argsort(whole, kind="stable")
    as_before = np.ones(len(order), bool)
    as_before[0:1] = False
    as_before[1:] = whole[order][1:] == whole[order][:-1]
    if bucket is not None:
        as_before[1:] &= bucket[order][1:] == bucket[order][:-1]
    pair = np.flatnonzero(as_before)
    a, b = at[order[pair]], at[order[pair - 1]]
    same = np.ones(len(pair), bool)
    for j in range(k):
        same &= words[a + j] == words[b + j]
    as_before[pair] = same
    head = order[np.maximum.accumulate(np.where(as_before, 0, np.arange(len(order))))]
    out = np.zeros(len(order), bool)
    out[order] = as_before & ((doc[order] != doc[head]) | (start[order] != start[head]))
    return out


def _table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest long), row (a hash of the text), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


def super_kmers(rows: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Places of the super-k-mers of windows that are first in their stretch, and (known) of runs of windows that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            for w in chunks(batch.column(2), STRETCH):
                at, of = w.windows(k)
                if not len(at):
                    continue
                doc, row, start = ids[w.rows][of], hashes[w.rows][of], at - w.first[of]
                if (np.diff(ids[w.rows]) < 0).any():
                    by_doc = np.lexsort((start, doc))
                    at, of, doc, row, start = (x[by_doc] for x in (at, of, doc, row, start))
                h = w.hashes(lower=False)
                whole = window_hashes(h, at, k)
                runs = window_hashes(h, np.arange(len(h) - m + 1), m)
                least = (sliding_min(runs, k - m + 1) + mix(sliding_min(mix(runs), k - m + 1)))[at].view(np.int64)
                again = _repeats(whole, w.codes(), at, k, doc, start)
                for known, some in ((True, np.flatnonzero(again)), (False, np.flatnonzero(~again))):
                    first, n = _runs(at[some], of[some] if known else least[some] ^ of[some])
                    i = some[first]
                    yield _table(_PLACES, least[i], doc[i], row[i], start[i], n, np.full(len(i), known))

    return rows.mapInArrow(run, "bucket long, doc_id long, row long, start long, n long, known boolean")


def meeting(places: DataFrame) -> DataFrame:
    """The known places, and those whose bucket holds more than one super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, met = None, False  # the last row so far, and whether the row before it has its bucket
        for batch in batches:
            t = pa.Table.from_batches([batch] if pending is None else [pending, batch])
            if not t.num_rows:
                continue
            b = t["bucket"].to_numpy()
            same = b[1:] == b[:-1]
            before, after = np.concatenate([[met], same]), np.concatenate([same, [False]])
            keep = before | after | t["known"].to_numpy().astype(bool)
            yield from t.take(pa.array(np.flatnonzero(keep[:-1]))).combine_chunks().to_batches()
            pending, met = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0], bool(before[-1])
        if pending is not None and (met or pending.column("known")[0].as_py()):
            yield pending

    return places.repartition(partitions(places.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, places.schema)


def packed(rows: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """The super-k-mers at places, each with the stretch of text that holds its windows."""
    wanted = places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("bucket", "start", "n")).alias("at"))
    joined = rows.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "at.bucket", "at.start", "at.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, starts, ns = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for w in chunks(batch.column(2)):
                text = w.data.tobytes()
                out: list[list] = [[], [], [], []]
                for i, r in enumerate(w.rows.tolist()):
                    lo = w.starts[w.first[i] + np.asarray(starts[r])]
                    hi = w.ends[w.first[i] + np.asarray(starts[r]) + np.asarray(ns[r]) + k - 2]
                    out[0] += buckets[r]
                    out[1] += [r] * len(lo)
                    out[2] += starts[r]
                    out[3] += [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                of = pa.array(out[1], pa.int64())
                yield _table(_PACKED, pa.array(out[0], pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string()))

    return joined.mapInArrow(run, "bucket long, doc_id long, row long, start long, packed string")


def repeated_runs(sent: DataFrame, k: int = K) -> DataFrame:
    """doc_id, row, start, n: runs of n repeated windows of a text, from its word start on."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        bucket, doc, row, start = (table.column(c).to_numpy() for c in _PACKED[:4])
        (w,) = chunks(table.column("packed").cast(pa.large_string()).combine_chunks(), 1 << 60)
        at, of = w.windows(k)
        h = w.hashes(lower=False)
        whole = window_hashes(h, at, k)
        d, s = doc[of], start[of] + at - w.first[of]
        again = np.flatnonzero(_repeats(whole, w.codes(), at, k, d, s, bucket[of]))
        first, n = _runs(at[again], of[again])
        i = again[first]
        return _table(_FOUND, d[i], row[of[i]], s[i], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, pa.Table.from_batches([batch])], size + batch.nbytes
            if size > STRETCH:  # all but the last bucket, which may go on
                t = pa.concat_tables(held)
                b = t["bucket"].to_numpy()
                whole = int(np.searchsorted(b, b[-1])) if len(b) else 0
                if whole:
                    yield settle(t.slice(0, whole))
                held = [t.slice(whole)]
                size = held[0].nbytes
        t = pa.concat_tables(held) if held else None
        if t is not None and t.num_rows:
            yield settle(t)

    spread = sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "start")
    return spread.mapInArrow(run, "doc_id long, row long, start long, n long")


def dedup_substrings(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by one space) for each row of docs (doc_id, text)."""
    rows = keyed(docs)
    places = durable(meeting(super_kmers(rows, k, m)), "places")
    # rows meets both joins in one plan by the same key, so its shuffle is made once and reused
    runs = repeated_runs(packed(rows, places.where("NOT known"), k), k).union(places.where("known").select(*_FOUND))
    runs = runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs.start", "runs.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, removed, kept = [], [], []
                for text, start, n in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = (text or "").encode().split()
                    counts.append(len(words))
                    if start:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, np.asarray(start) + np.asarray(n) + k - 1, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield _table(["doc_id", "n_words", "n_removed", "kept"], part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()))

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], k: int = K) -> list[tuple]:
    """The same result in plain Python, for tests with distinct doc_ids."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone.update(range(i, i + k))
            seen.add(window)
        kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
k AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
