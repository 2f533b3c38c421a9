"""Vector code compression: product codebooks whose entries are found by equal-average search.

Components become integers floor(scale * x); a vector is cut into equal parts, each with its own codebook of at most `entries` entries. A part
meets the entries in the order of their component sums, outward from its own sum. By the Cauchy-Schwarz inequality an entry is no nearer than
its sum gap squared over the part's dimension, so the search of a part ends where that strictly exceeds the best distance (an equal bound may
still hold an equally near entry of lower index).

Every pass reads the table once and shuffles only per-task sums of the entries (parts x entries rows a task). What the driver holds is the
codebook: entries x dimensions numbers, whatever the table's size.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; shorter vectors count as padded with zeros to
the longest length, which is rounded up to a multiple of the parts; null ids sort last, and rows of one id by their vector; with fewer rows
than entries the codebooks are shorter; an error beyond a long stays at the largest long; an empty table gives no row; other columns are
ignored. Integers too large for 64-bit products are computed exactly as Python integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_MOST = 2**63 - 1
_SUM_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

#: The same rows in DuckDB.
SQL = r"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v, len(embedding) // 16 AS d FROM embeddings
              WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))),
x AS (SELECT r, vec_id, label, (i - 1) // d AS part, (i - 1) % d AS pos, floor(256 * v[i]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS (SELECT part, r AS entry, pos, x AS y FROM x WHERE r < 64),
a0 AS (SELECT r, part, min(q) % 64 AS entry FROM (SELECT r, x.part, sum((x - y) * (x - y)) * 64 + entry AS q FROM x JOIN b0 USING (part, pos) GROUP BY r, x.part, entry) GROUP BY r, part),
m1 AS (SELECT part, entry, pos, floor(sum(x) / count(*)) AS y FROM x JOIN a0 USING (r, part) GROUP BY part, entry, pos),
b1 AS (SELECT part, entry, pos, coalesce(m1.y, b0.y)::BIGINT AS y FROM b0 LEFT JOIN m1 USING (part, entry, pos)),
a1 AS (SELECT r, part, min(q) % 64 AS entry FROM (SELECT r, x.part, sum((x - y) * (x - y)) * 64 + entry AS q FROM x JOIN b1 USING (part, pos) GROUP BY r, x.part, entry) GROUP BY r, part),
m2 AS (SELECT part, entry, pos, floor(sum(x) / count(*)) AS y FROM x JOIN a1 USING (r, part) GROUP BY part, entry, pos),
b2 AS (SELECT part, entry, pos, coalesce(m2.y, b1.y)::BIGINT AS y FROM b1 LEFT JOIN m2 USING (part, entry, pos)),
a2 AS (SELECT r, part, min(q) AS q FROM (SELECT r, x.part, sum((x - y) * (x - y)) * 64 + entry AS q FROM x JOIN b2 USING (part, pos) GROUP BY r, x.part, entry) GROUP BY r, part),
f AS (SELECT r, string_agg(printf('%02x', (q % 64)::INTEGER), '' ORDER BY part) AS code, sum(q // 64)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM kept JOIN f USING (r)
"""


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def _limit(d: int) -> int:
    """Integers up to this keep squared sum gaps, and best distance times dimension, in 64 bits."""
    return 2 ** max(0, (61 - 2 * math.ceil(math.log2(max(d, 1)))) // 2)


def kept_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with whole finite vectors, and these vectors' components end to end with their lengths."""
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=0).astype(np.int64)
    valid = ~vectors.is_null().to_numpy(zero_copy_only=False)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.where(valid, lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    whole = valid & (bad[ends] == bad[ends - np.where(valid, lengths, 0)])
    return np.flatnonzero(whole), x[np.repeat(whole, np.where(valid, lengths, 0))], lengths[whole]


def integers(x: np.ndarray, lengths: np.ndarray, width: int, limit: int | None, scale: int = SCALE) -> np.ndarray:
    """A row of `width` integers for each vector, padded with zeros; Python integers when one is beyond limit, or without a limit."""
    if limit is None or np.any(np.abs(x) > limit / scale):
        flat = np.array([_whole(v, scale) for v in x.tolist()], object)
    else:
        flat = np.floor(scale * x).astype(np.int64)
    if np.all(lengths == width):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Codebook:
    """One part's entries, in the order of their sums (ties: of their indexes)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, sums = entries, entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.d = sums[self.order], entries.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry (ties to the lower index), its squared distance, and how many distances were computed in all."""
        k, total, tried = len(self.sums), x.sum(axis=1), 0
        right = np.searchsorted(self.sums, total)
        left = right - 1
        best, index = np.zeros(len(x), x.dtype), np.full(len(x), -1)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[(left[rows] >= 0) | (right[rows] < k)]
            lo, hi, s = left[rows], right[rows], total[rows]
            low_gap, high_gap = s - self.sums[lo], self.sums[np.minimum(hi, k - 1)] - s
            down = (hi == k) | ((lo >= 0) & (low_gap <= high_gap))
            gap = np.where(down, low_gap, high_gap)
            go = ((index[rows] < 0) | ~(gap * gap > best[rows] * self.d)).astype(bool)
            rows, down = rows[go], down[go]
            entry = self.order[np.where(down, lo[go], hi[go])]
            gaps = x[rows] - self.entries[entry]
            far = (gaps * gaps).sum(axis=1)
            tried += len(rows)
            better = (index[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (entry < index[rows]))
            better = better.astype(bool)
            best[rows[better]], index[rows[better]] = far[better], entry[better]
            left[rows[down]] -= 1
            right[rows[~down]] += 1
        return index, best, tried


def _batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch's kept rows, and their vectors as (row, part, position) integers of the same type as the codebooks if these are Python's."""
    parts, _, d = books.shape
    for batch in batches:
        keep, x, lengths = kept_rows(batch.column(batch.num_columns - 1))
        if len(keep):
            v = integers(x, lengths, parts * d, None if books.dtype == object else _limit(d)).reshape(len(keep), parts, d)
            yield batch.take(pa.array(keep)), v


def _books(books: np.ndarray, like: np.ndarray) -> list[Codebook]:
    return [Codebook(b.astype(like.dtype)) for b in books]


def first_entries(rows: DataFrame, entries: int) -> tuple[list[list[float]], int]:
    """The vectors of the smallest kept ids, and the longest kept vector's length. Each task gives at most `entries` rows."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, longest = [], 0
        for batch in batches:
            keep, _, lengths = kept_rows(batch.column(1))
            if len(keep):
                longest = max(longest, int(lengths.max()))
                ids = batch.column(0).take(pa.array(keep))
                null = ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy()
                place = np.lexsort((number, null))
                # rows that tie with the last one wanted stay until their vectors are compared
                last = place[min(entries, len(place)) - 1]
                wanted = place[(null[place] < null[last]) | ((null[place] == null[last]) & (number[place] <= number[last]))]
                some = batch.take(pa.array(keep[np.sort(wanted)]))
                held += [(i is None, i or 0, v) for i, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)]
                held = sorted(held)[:entries]
        yield pa.RecordBatch.from_pylist([{"vec_id": None if n else i, "v": v, "longest": longest} for n, i, v in held], pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("longest", pa.int64())]))

    first = durable(rows.select("vec_id", "v").mapInArrow(smallest, "vec_id long, v array<double>, longest long"), "smallest")
    longest = first.agg(F.max("longest")).first()[0]
    return [r.v for r in first.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], longest or 0


def _limbs(x: int) -> list[int]:
    """x as digits of 40 bits, lowest first, each with the sign of x: sums of them fit a long, whatever the size of x."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & (1 << 40) - 1))
        x >>= 40
    return out


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, pos, limb, n, x: the sums of the parts that each entry is nearest to, over all rows, in limbs of 40 bits."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for _, v in _batches(batches, books):
            for p, book in enumerate(_books(books, v)):
                index, _, _ = book.nearest(v[:, p])
                batch_sums = np.zeros(books.shape[1:], v.dtype)
                np.add.at(batch_sums, index, v[:, p])
                sums[p] += batch_sums.astype(object)
                counts[p] += np.bincount(index, minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        rows = [(p, e, pos, limb, n, x) for p, e, n in zip(part.tolist(), entry.tolist(), counts[part, entry].tolist(), strict=True) for pos, total in enumerate(sums[p, e]) for limb, x in enumerate(_limbs(int(total)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SUM_TYPES, strict=True)] if rows else [pa.array([], t) for t in _SUM_TYPES], names=["part", "entry", "pos", "limb", "n", "x"])

    tasks = rows.select("v").mapInArrow(assign, "part int, entry int, pos int, limb int, n long, x long")
    return tasks.groupBy("part", "entry", "pos", "limb").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) of rows (vec_id, v)."""
    first, longest = first_entries(rows, entries)
    d = -(-longest // parts)
    lengths, limit = np.array([len(v) for v in first], np.int64), _limit(d)
    books = integers(np.array([x for v in first for x in v], np.float64), lengths, parts * d, limit).reshape(len(first), parts, d).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) and d else 0):
        totals, counts, wide = np.zeros(books.shape, object), np.zeros(books.shape[:2], object), books.astype(object)
        for r in _sums(rows, books).toLocalIterator():  # some rows for each component of the codebooks
            totals[r.part, r.entry, r.pos] += r.x << 40 * r.limb
            counts[r.part, r.entry] = max(counts[r.part, r.entry], r.n)
        used = counts > 0
        wide[used] = totals[used] // counts[used][:, None]
        books = wide.astype(np.int64) if not len(wide.ravel()) or max(map(abs, wide.ravel())) <= limit else wide
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (array of entry indexes), error of rows (vec_id, label, v)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.list_(pa.int32())), ("error", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, v in _batches(batches, books):
            found = [book.nearest(v[:, p])[:2] for p, book in enumerate(_books(books, v))]
            code = np.stack([i for i, _ in found], axis=1)
            error = [min(int(e), _MOST) for e in sum(far.astype(object) for _, far in found)]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(list(code), pa.list_(pa.int32())), pa.array(error, pa.int64())], schema=schema)

    return rows.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label string, code array<int>, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes (vec_id, label as text, code, error, label_error) and the codebooks."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    books = fit(rows, parts, entries, rounds)
    coded = durable(encode(rows, books), "codes")
    # errors are added up before they move; the few rows of sums meet the codes by label, whose hot ones AQE splits
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_MOST))).cast("long").alias("label_error"))
    return coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label"))).select("c.*", "label_error"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors)
    code = F.concat_ws("", F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def brute_force(rows: list[tuple], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[tuple], list]:
    """(vec_id, label, code, error) and the codebooks in plain Python, for tests."""
    kept = [(i, lab, [math.floor(SCALE * x) if abs(x) < 2**53 else int(x) * SCALE for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x: list[int], p: int) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == e]
                if members:
                    books[p][e] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = []
    for (i, lab, _), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], p) for p in range(parts)]
        out.append((i, lab, [e for _, e in best], min(sum(d for d, _ in best), _MOST)))
    return out, books
