"""Suppliers of items, lead times, and supplier-name resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import LEAD_DAYS, lookup, match_key, removed_words, stripped_key, supplier_type

from .durable import durable
from .ordered import Fill, Number, in_order

FUZZY = 0.85
BLOCK, STEP = 2048, 500_000


def latest_supplier(orders: DataFrame, keys: list[str]) -> DataFrame:
    """The supplier of the last purchase-order row of each item."""
    return orders.groupBy(*keys).agg(F.max_by("supplier", "row_no").alias("supplier"))


def lead_times(profiles: DataFrame) -> DataFrame:
    """supplier, supplier_type, lead_days, delay, quality, high_risk; zero lead times count as missing."""
    kind = supplier_type(F.col("type_raw"))
    lead = F.coalesce(F.nullif(F.col("avg_lead_time_days").cast("int"), F.lit(0)), lookup(kind, LEAD_DAYS))
    delay, quality = F.coalesce("delay_probability", F.lit(0.2)), F.coalesce("data_quality_score", F.lit(0.3))
    return profiles.select("supplier", kind.alias("supplier_type"), lead.alias("lead_days"), delay.alias("delay"), quality.alias("quality"), ((delay > 0.30) | (quality < 0.50)).alias("high_risk"))


def blocky(rows: DataFrame, column: str = "supplier_raw") -> DataFrame:
    """session_id, blocky: the column's non-blank values come in one run each, the first within two rows of the top."""
    named = rows.select("session_id", "row_no", F.nullif(F.trim(column), F.lit("")).alias("x"))
    filled = in_order(named, ["session_id"], ["row_no"], {"at": Number(), "before": Fill("x", before=True)}).where("x IS NOT NULL")
    # first by value, then by session: a session of many rows is added up in many tasks
    values = filled.groupBy("session_id", "x").agg(F.count_if(F.col("before").isNull() | (F.col("before") != F.col("x"))).alias("runs"), F.min("at").alias("at"))
    return values.groupBy("session_id").agg(((F.sum("runs") == F.count("*")) & (F.min("at") <= 2)).alias("blocky"))


def sheet_supplier(rows: DataFrame, key: str = "key") -> DataFrame:
    """session_id, key, supplier: the only supplier named on an item's own rows, or (in blocky columns) above them; none if two are."""
    own = in_order(rows.withColumn("own", F.nullif(F.trim("supplier_raw"), F.lit(""))), ["session_id"], ["row_no"], {"filled": Fill("own")})
    sets = own.groupBy("session_id", key).agg(F.collect_set("own").alias("own"), F.collect_set("filled").alias("filled")).join(F.broadcast(blocky(rows)), "session_id", "left")
    names = F.when(F.size("own") > 0, F.col("own")).when(F.col("blocky"), F.col("filled")).otherwise(F.array().cast("array<string>"))
    return sets.select("session_id", key, F.when(F.size(names) == 1, F.get(names, F.lit(0))).alias("supplier")).where("supplier IS NOT NULL")


def suffix_groups(names: DataFrame) -> DataFrame:
    """org_name, stem, n_names, names, removed: names of one organisation that differ in legal or trade words only."""
    distinct = names.select("org_name", "supplier").distinct().withColumn("stem", stripped_key(F.col("supplier")))
    return distinct.groupBy("org_name", "stem").agg(
        F.count("*").alias("n_names"), F.array_sort(F.collect_set("supplier")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(removed_words(F.col("supplier")))))).alias("removed")
    ).where("n_names > 1")


def fuzzy_pairs(names: DataFrame, threshold: float = FUZZY, block: int = BLOCK) -> DataFrame:
    """org_name, a, b, ratio: match keys of one organisation with a sequence-matcher ratio of threshold or more.

    The ratio is 2 M / L, where M letters of L together are common to both in one order. All pairs are asked two questions that cost little:
    how many letters are common in any order (one product of matrices for two blocks of keys), then, if these are enough, how many in
    the same order at most (longest common subsequences, a bit for each letter). Only what is left reaches the sequence matcher. Keys lie in
    blocks in order of organisation and length, and blocks whose organisations or lengths rule each other out do not meet; each task reads its
    blocks of both sides where they are written, so nothing is copied for a pair and memory is bounded by two blocks.
    """
    keys = names.select("org_name", match_key(F.col("supplier")).alias("k")).where("k <> '' AND org_name IS NOT NULL").distinct().withColumn("n", F.length("k"))
    order = ["org_name", "n", "k"]
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                org, n, k = (batch.column(i).slice(lo, block).to_pylist() for i in range(3))
                yield pa.RecordBatch.from_pylist([{"org": org[0], "last_org": org[-1], "n": n[0], "last_n": n[-1], "k": k[0], "orgs": org, "keys": k}], schema=packed)

    packed = pa.schema([("org", pa.string()), ("last_org", pa.string()), ("n", pa.int32()), ("last_n", pa.int32()), ("k", pa.string()), ("orgs", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))])
    blocks = durable(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order).mapInArrow(pack, "org string, last_org string, n int, last_n int, k string, orgs array<string>, keys array<string>"), "keys")
    side = lambda x: blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns])
    place = lambda x: F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("org", "n", "k")])
    # blocks are in order: the left one's lengths end where the right one's begin, if both are of one organisation
    mixed = (F.col("org_l") < F.col("last_org_l")) | (F.col("org_r") < F.col("last_org_r"))
    near = 2 * F.least("last_n_l", "n_r") >= F.lit(threshold) * (F.col("last_n_l") + F.col("n_r")) - F.lit(1e-9)
    meet = (place("l") <= place("r")) & (F.col("last_org_l") >= F.col("org_r")) & (mixed | near | (F.col("n_r") <= F.col("last_n_l")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for org_l, keys_l, org_r, keys_r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j = _common_letters(keys_l, org_l, keys_r, org_r, threshold)
                if (org_l[0], keys_l[0]) == (org_r[0], keys_r[0]):
                    i, j = i[i < j], j[i < j]
                for lo in range(0, len(i), STEP):
                    x, y = _common_in_order(keys_l, keys_r, i[lo : lo + STEP], j[lo : lo + STEP], threshold)
                    pairs = [(org_l[p], *sorted((keys_l[p], keys_r[q]))) for p, q in zip(x, y, strict=True)]
                    found = pd.DataFrame(pairs, columns=["org_name", "a", "b"])
                    found["ratio"] = _ratios(found["a"], found["b"], threshold)
                    yield pa.RecordBatch.from_pandas(found[found["ratio"].notna()].astype({"ratio": float}), preserve_index=False, schema=pa.schema([("org_name", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ratio", pa.float64())]))

    pairs = side("l").hint("shuffle_replicate_nl").crossJoin(side("r")).where(meet)
    return pairs.select("orgs_l", "keys_l", "orgs_r", "keys_r").mapInArrow(run, "org_name string, a string, b string, ratio double")


def _letters(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters of keys in one row: which key, which place in it, which of 36 letters; and the keys' lengths. Match keys hold a-z and 0-9."""
    n = np.array([len(k) for k in keys])
    code = np.frombuffer("".join(keys).encode("ascii"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), n)
    return row, np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n), np.where(code < 58, code - 48, code - 87), n


def _common_letters(left: list[str], org_l: list[str], right: list[str], org_r: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places in left and right) of one organisation whose common letters, each as often as both have it, are enough."""
    counts, sizes = [], []
    for keys in (left, right):
        row, _, letter, n = _letters(keys)
        counts.append(np.bincount(row * 36 + letter, minlength=len(keys) * 36).reshape(-1, 36))
        sizes.append(n)
    # a letter's second occurrence is another column than its first, so products count common ones
    used = [(c, t) for c in range(36) for t in range(1, 1 + min(counts[0][:, c].max(), counts[1][:, c].max()))]
    have = [np.stack([x[:, c] >= t for c, t in used], 1).astype(np.float32) if used else np.zeros((len(x), 1), np.float32) for x in counts]
    codes = {o: i for i, o in enumerate(dict.fromkeys((*org_l, *org_r)))}
    orgs = [np.array([codes[o] for o in x]) for x in (org_l, org_r)]
    enough = 2 * (have[0] @ have[1].T) >= threshold * (sizes[0][:, None] + sizes[1][None, :]) - 1e-9
    return np.nonzero(enough & (orgs[0][:, None] == orgs[1][None, :]))


def _common_in_order(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that have enough letters in common in one order; keys over 64 letters are not asked."""
    row, at, letter, n = _letters(left)
    short = n[row] <= 64
    places = np.zeros((len(left), 37), np.uint64)
    np.bitwise_or.at(places, (row[short], letter[short]), np.uint64(1) << at[short].astype(np.uint64))
    row, at, letter, m = _letters(right)
    text = np.full((len(right), m.max()), 36)
    text[row, at] = letter
    open_ = np.full(len(i), ~np.uint64(0))
    for p in range(m[j].max() if len(j) else 0):
        hit = open_ & places[i, text[j, p]]
        open_ = (open_ + hit) | (open_ - hit)
    common = np.bitwise_count(~open_).astype(np.int64)
    keep = (n[i] > 64) | (2 * common >= threshold * (n[i] + m[j]) - 1e-9)
    return i[keep], j[keep]


def _ratios(a: pd.Series, b: pd.Series, threshold: float) -> pd.Series:
    """The ratio of each pair, null below the threshold."""
    from difflib import SequenceMatcher

    out, last, matcher = np.full(len(a), np.nan), None, SequenceMatcher(None)
    for at in np.argsort(b.to_numpy(str), kind="stable") if len(a) else []:
        if b.iat[at] != last:
            last = b.iat[at]
            matcher.set_seq2(last)  # the matcher indexes its second text once
        matcher.set_seq1(a.iat[at])
        ratio = matcher.ratio()
        if ratio >= threshold:
            out[at] = ratio
    return pd.Series(out)
