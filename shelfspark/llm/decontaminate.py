"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, units after numbers, and names (capitalised inside a sentence) become typed
placeholders whose values are kept aside as slots. Windows of WINDOW template words of documents are hash-joined with those of benchmark
items. Hits of one item on one alignment (document position minus item position) form a match. Consecutive windows cover a stretch of words;
what counts is its longest part in which the slots agree: each value of the item stands for one value of the document, and the other way
round. A leak has such a part of RUN words (or the whole of a shorter item), so copies with other numbers or names are caught, one value
that does not fit costs only its surroundings, and chance templates are not taken.

Whether a capital makes a name depends on the sentence around it, so verbatim copies are also found without types: windows of RUN literal
words (or the whole of a shorter item), lower-cased and without punctuation, are joined in the same way. A leak is what either way finds.

Template windows in which more than half of the words are placeholders are not evidence, nor are templates of fewer than SHORTEST words:
such items are searched for verbatim only. Items shorter than a window are one window of their own length. Literal matches have no slots.

Before the join, documents drop windows whose hash is not in a Bloom filter of the benchmark's hashes. The filter has FILTER_BITS bits
whatever the benchmark's size; a larger benchmark lets more windows through, and the join decides.

Defined cases: null texts and items have no words; a null doc_id or item_id is reported as such; rows with equal doc_id are matched row by
row and reported once per item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import Words, _words, chunks, span_hashes, window_hashes, _BYTES

WINDOW, RUN, SHORTEST = 8, 13, 5
FILTER_BITS = 1 << 26
_LITERAL = np.uint64(1 << 63)
# Units that may follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes ml l litre litres liter liters gal gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years k c f degree degrees percent pct usd eur gbp dollar dollars cent cents euro euros pound pounds hz khz mhz ghz kb mb gb tb w kw mw v j kj cal kcal mph kmh kph".split()
_PUNCT = np.array([b < 128 and not (chr(b).isalnum() or b == 0x20 or 9 <= b <= 13) for b in range(256)])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), [*b".!?\n"])


def _hash_words(words: list[str]) -> np.ndarray:
    w = next(chunks(pa.array([" ".join(words)])))
    return w.hashes(lower=True)


_UNIT_HASHES = np.sort(_hash_words(UNITS))
_NUMBER, _NAME, _UNIT = _hash_words(["<number>", "<name>", "<unit>"])


def templates(w: Words) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of w without punctuation; their template hashes; their slot values (0 where a word is literal); their literal hashes."""
    none = np.zeros(0, np.uint64)
    if not len(w.starts):
        return w, none, none, none
    data = w.data
    offsets = np.concatenate([w.starts, [len(data)]])[np.minimum(w.first, len(w.starts))]  # white space around a text is dropped with it
    kept = np.flatnonzero(~_PUNCT[data])
    small = data[kept].copy()
    small[(small >= 65) & (small <= 90)] += 32
    after_c3 = np.flatnonzero(small[:-1] == 0xC3) + 1
    capital = after_c3[(small[after_c3] >= 0x80) & (small[after_c3] <= 0x9E) & (small[after_c3] != 0x97)]
    small[capital] += 0x20
    t = _words(small, np.searchsorted(kept, offsets), w.rows)
    if not len(t.starts):
        return t, none, none, none
    value = span_hashes(small + np.uint64(1), t.starts, t.ends, _BYTES)
    at = kept[t.starts]
    upper = ((data[at] >= 65) & (data[at] <= 90)) | np.isin(t.starts + 1, capital)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(at), bool)
    opens[1:] = stops[at[1:]] > stops[at[:-1]]
    opens[t.first[:-1][t.counts > 0]] = True
    digits = np.concatenate([[0], np.cumsum(_DIGIT[small])])
    number = digits[t.ends] > digits[t.starts]
    unit = np.zeros(len(at), bool)
    unit[1:] = number[:-1] & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value[1:]), len(_UNIT_HASHES) - 1)] == value[1:])
    unit[t.first[:-1][t.counts > 0]] = False
    name = upper & ~opens & ~number & ~unit & (t.ends - t.starts > 1)
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return t, template, np.where(number | unit | name, value, np.uint64(0)), value


def template_windows(rows: DataFrame, lengths: list[tuple[bool, int]] | None = None, known: Broadcast | None = None) -> DataFrame:
    """hash, id, row, literal, at, n (words), words (of the text), slots: template and literal windows of rows (id, row, text).

    Windows have WINDOW words (literal ones RUN) and each of lengths (literal, words); without lengths, a shorter text is one window of its
    kind. known: a Bloom filter of the hashes to keep.
    """
    full = {False: WINDOW, True: RUN}
    sizes = [*full.items(), *(lengths if lengths is not None else ((kind, k) for kind in full for k in range(1 if kind else SHORTEST, full[kind])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(2)):
                t, template, slots, value = templates(w)
                plain = np.concatenate([[0], np.cumsum(slots == 0)])
                for literal, k in sizes:
                    at, of = t.windows(k)
                    keep = np.ones(len(at), bool) if literal else 2 * (plain[at + k] - plain[at]) >= k
                    if lengths is None and k < full[literal]:
                        keep &= t.counts[of] == k
                    h = window_hashes(value, at, k) ^ np.uint64(k) ^ _LITERAL if literal else window_hashes(template, at, k) ^ np.uint64(k)
                    if known is not None:
                        keep &= in_filter(known.value, h)
                    i = np.flatnonzero(keep)
                    if len(i):
                        row = pa.array(t.rows[of[i]])
                        packed = [b"" if literal else slots[a : a + k].tobytes() for a in at[i].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[i].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(i), literal)), pa.array(at[i] - t.first[of[i]]), pa.array(np.full(len(i), k, np.int64)), pa.array(t.counts[of[i]]), pa.array(packed, pa.binary())],
                            ["hash", "id", "row", "literal", "at", "n", "words", "slots"],
                        )

    return rows.mapInArrow(run, "hash long, id long, row long, literal boolean, at long, n long, words long, slots binary")


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of column hash: FILTER_BITS bits, of which the words that are not 0 (a bounded number) reach the driver."""
    bit = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    rows = hashes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(hash, {FILTER_BITS}) & 63))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(64 * len(words) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def longest_consistent(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """(begin, end) of the longest part of a stretch of words, given as (item's value, document's value; 0: no slot), in which values
    correspond one to one."""
    means: dict = {}  # of both sides: [partner, uses]
    best, a = (0, 0), 0
    for b, (x, y) in enumerate(pairs):
        if x:
            while any(k in means and means[k][0] != v for k, v in (((0, x), y), ((1, y), x))):
                u, v = pairs[a]
                a += 1
                if u:
                    for k in ((0, u), (1, v)):
                        means[k][1] -= 1
                        if not means[k][1]:
                            del means[k]
            for k, v in (((0, x), y), ((1, y), x)):
                means.setdefault(k, [v, 0])[1] += 1
        if b + 1 - a > best[1] - best[0]:
            best = (a, b + 1)
    return best


def _judge(hits: pd.Series) -> pd.DataFrame:
    """Of the windows of one item on one alignment: the words of the longest consistent part of a stretch, its slots, and how many of them
    have other values in the document."""
    out = []
    for windows in hits:
        words: dict = {}
        for h in windows:
            pairs = zip(np.frombuffer(h["theirs"], np.uint64).tolist(), np.frombuffer(h["ours"], np.uint64).tolist(), strict=True) if h["theirs"] else ((0, 0) for _ in range(h["n"]))
            for i, pair in enumerate(pairs, h["at"]):
                words[i] = pair
        best, places = (0, 0, 0), sorted(words)
        breaks = [i for i in range(1, len(places)) if places[i] != places[i - 1] + 1]
        for a, b in zip([0, *breaks], [*breaks, len(places)], strict=True):
            stretch = [words[i] for i in places[a:b]]
            x, y = longest_consistent(stretch)
            filled = [p for p in stretch[x:y] if p[0]]
            best = max(best, (y - x, len(filled), sum(p[0] != p[1] for p in filled)), key=lambda z: (z[0], -z[2]))
        out.append(best)
    return pd.DataFrame(out, columns=["covered", "slots", "changed"])


def leaks(docs: DataFrame, benchmark: DataFrame, by_row: bool = False) -> DataFrame:
    """doc_id, item_id, n_words (of the item found in a run), item_words, n_slots, n_changed for each document that holds a benchmark item;
    by_row: for each doc_id and row (a hash of the text)."""
    who = ["doc_id", "row"] if by_row else ["doc_id"]
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    known = durable(template_windows(items), "windows")
    short = F.col("n") < F.when(F.col("literal"), RUN).otherwise(WINDOW)
    lengths = [(r[0], r[1]) for r in known.where(short).select("literal", "n").distinct().collect()]  # at most WINDOW + RUN values
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    found = template_windows(rows, lengths, spark.sparkContext.broadcast(filter_of(known)))
    theirs = known.select("hash", "literal", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n", F.col("words").alias("item_words"), F.col("slots").alias("theirs"))
    hits = found.select("hash", "literal", F.col("id").alias("doc_id"), "row", "at", F.col("slots").alias("ours")).join(theirs, ["hash", "literal"])
    # a group has at most one different hit for each window of the item: repeated rows are combined before they are sent
    matches = hits.groupBy("doc_id", "row", "item_id", "item_words", "literal", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct(F.col("item_at").alias("at"), "n", "theirs", "ours")).alias("hits")
    )
    judged = matches.select("doc_id", "row", "item_id", "item_words", F.pandas_udf(_judge, "covered long, slots long, changed long")("hits").alias("j")).where(F.col("j.covered") >= F.least(F.lit(RUN), F.col("item_words")))
    best = judged.groupBy(*who, "item_id").agg(F.max(F.struct("j.covered", "item_words", "j.slots", -F.col("j.changed"))).alias("b"))
    return best.select(*who, "item_id", F.col("b.covered").alias("n_words"), F.col("b.item_words").alias("item_words"), F.col("b.slots").alias("n_slots"), (-F.col("b.col4")).alias("n_changed"))
