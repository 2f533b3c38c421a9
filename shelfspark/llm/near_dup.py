"""HyperMinHash near-duplicate detection.

Each text's set of distinct word shingles is hashed once. The top bits of a hash choose one of 256 registers; a register keeps its
smallest hash as a leading-zero count plus 10 mantissa bits. Empty registers borrow from others by a fixed probe order, so short texts band
like long ones. Texts with equal sets form a class; only class representatives go on. 42 bands of 6 registers give buckets (a pair at
similarity 0.8 shares none with probability 3e-6). Candidate pairs of a bucket are estimated from registers, corrected for chance
collisions of compressed registers, and then confirmed on the full sets.

No bucket is expanded into all its pairs: every member is compared with the bucket's smallest id; then members outside the bucket's main
component are compared with several members of it; what still lies in different components is compared in full, in blocks that give one
link for each component they join, so no connection is lost and no list of pairs is made.

Defined cases: null or wordless texts have an empty set and link with nothing; fewer words than a shingle make one shingle of all words;
rows with a null doc_id have a null component and are kept; rows with equal doc_id are texts of their own, each in the component of its text,
whose name is the smallest doc_id of its texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import connected
from .words import chunks, mix, span_hashes, window_hashes

BITS, MANTISSA, BAND = 8, 10, 6
REGISTERS = 1 << BITS
BANDS = REGISTERS // BAND
#: Estimates this far under the threshold are refuted without the full sets: over 6 standard deviations at 256 registers.
MARGIN = 0.17
LEADS, BLOCK, BLOCK_BYTES = 6, 256, 8_000_000
_SLOTS = np.arange(REGISTERS)
_PROBES = [(mix(_SLOTS.astype(np.uint64) * np.uint64(0x9E37) + np.uint64(t << 32)) % np.uint64(REGISTERS)).astype(np.int64) for t in range(64)]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for w in chunks(texts):
        h = w.hashes(lower=True)
        at, of = w.windows(k)
        shingles, n = window_hashes(h, at, k), np.bincount(of, minlength=len(w.rows))
        ends, counts = np.cumsum(n), w.counts
        short = np.flatnonzero((counts > 0) & (counts < k))
        single = dict(zip(short.tolist(), span_hashes(h, w.first[short], w.first[short + 1]), strict=True))
        for i, row in enumerate(w.rows.tolist()):
            yield row, np.array([single[i]], np.uint64) if i in single else np.unique(shingles[ends[i] - n[i] : ends[i]])


def registers(shingles: np.ndarray) -> np.ndarray:
    """256 compressed registers (uint16) of a non-empty sorted set."""
    slot = (shingles >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    rest = shingles[first] << np.uint64(BITS)
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.longdouble))).astype(np.int64), 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[slot[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    filled[slot[first]] = True
    empty = np.flatnonzero(~filled)
    for probe in _PROBES:
        if not len(empty):
            break
        good = filled[probe[empty]]
        out[empty[good]] = out[probe[empty[good]]]
        empty = empty[~good]
    if len(empty):  # few filled registers: the next one around the circle
        have = np.flatnonzero(filled)
        out[empty] = out[have[np.searchsorted(have, empty) % len(have)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Jaccard from registers, less the matches that compressed registers have by chance."""
    size = 4 * (n_a / n_b) / (1 + n_a / n_b) ** 2
    chance = 0.169919487159739 * size / 2**MANTISSA * 2
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row, n_shingles, set_id (null for an empty set), registers for each row of docs (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, regs = [], [], []
            for _, s in shingle_sets(batch.column(2), k):
                sizes.append(len(s))
                names.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "row", "n_shingles", "set_id", "registers"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, set_id binary, registers binary")


def band_keys(signed: DataFrame) -> DataFrame:
    """key, id, n: one row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()])[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
            keys = np.full(regs.shape[:2], 1, np.uint64) * (np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
            for j in range(BAND):
                keys = mix(keys + regs[:, :, j])
            rep = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), rep(0), rep(1)], ["key", "id", "n"])

    return signed.select("id", "n", "registers").mapInArrow(run, "key long, id long, n long")


def confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets (id, n, registers, members) have 100 * intersection >= per_cent * union, as verdict rows
    (a, b, linked). The set of b travels with the pair; the set of a, often one id of many pairs, meets it in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, a = [], None, None
            for ra, sa, rb, sb in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                if sa is not last:
                    last, a, qa = sa, np.frombuffer(sa, np.uint64), np.frombuffer(ra, np.uint16)
                b = np.frombuffer(sb, np.uint64)
                if estimate(qa, np.frombuffer(rb, np.uint16), len(a), len(b)) < per_cent / 100 - MARGIN:
                    linked.append(False)
                    continue
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                linked.append(100 * both >= per_cent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("members").alias(f"s{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ra", "sa", "rb", "sb").mapInArrow(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, component_id, kept (doc_id = component_id), first (the row whose text stands for its
    component, or that is in none; repeated rows alike), copies (rows with this doc_id and text) for each row of docs (doc_id, text); texts
    link at similarity per_cent / 100 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    signed = durable(sign(docs, k), "signed")
    # a number of its own for each set: doc_ids may repeat
    rows = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id", "doc_id", "row").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    reps = durable(
        rows.groupBy("set_id").agg(F.min(F.struct("doc_id", "row", "copies")).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers")).withColumn("id", F.monotonically_increasing_id()), "reps",
    )
    bands = band_keys(reps)
    leads = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n")).where("size > 1")
    members = durable(bands.join(leads, "key"), "members")
    alike = lambda x, y: 100 * F.least(x, y) >= per_cent * F.greatest(x, y)  # noqa: E731  sizes that allow a link
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    ids = members.select("id").distinct()
    wanted = reps.join(ids, "id", "left_semi").select("id", "first.doc_id", "first.row", "first.copies")
    sets = durable(_sets(docs, wanted, k), "sets")

    first = members.where((F.col("id") != F.col("lead")) & alike(F.col("n"), F.col("lead_n"))).select(*pair(F.col("id"), F.col("lead"))).distinct()
    verdicts = durable(confirm(first, sets, per_cent), "verdicts")
    component = connected(verdicts.where("linked"))

    # members outside a bucket's main component meet a few of its members
    mixed = _mixed(members, component)
    inside = mixed.where("component = main").groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(s))) for s in range(LEADS)])).alias("some"))
    some = inside.select("key", F.explode("some").alias("o")).select("key", F.col("o.id").alias("other"), F.col("o.n").alias("other_n"))
    found = mixed.where("component <> main").join(some, "key").where(alike(F.col("n"), F.col("other_n"))).select(*pair(F.col("id"), F.col("other"))).distinct()
    new = durable(confirm(found.join(verdicts, ["a", "b"], "left_anti"), sets, per_cent), "verdicts")
    links = durable(verdicts.where("linked").select("a", "b").union(new.where("linked").select("a", "b")), "links")
    component = connected(links)
    # what still lies apart meets everything that shares a main component's buckets with it
    rest = durable(compare_blocks(_mixed(members, component).select("main", "id", "component", "n").distinct(), sets, per_cent), "links")
    component = connected(links.union(rest))

    linked = durable(component.join(reps.select("id", "set_id", "first"), "id"), "linked")
    names = linked.groupBy("component").agg(F.min("first").alias("top"))
    named = linked.join(names, "component").select("set_id", "top")
    out = signed.select("doc_id", "row", "n_shingles", "set_id").join(reps.select("set_id", "first"), "set_id", "left").join(named, "set_id", "left")
    top = F.coalesce("top", "first", F.struct("doc_id", "row", F.lit(1).cast("long").alias("copies")))
    known, component = F.col("doc_id").isNotNull(), F.when(F.col("doc_id").isNotNull(), top["doc_id"])
    first = ~known | ((F.col("doc_id") == top["doc_id"]) & (F.col("row") == top["row"]))
    return out.select(
        "doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), first.alias("first"),
        F.when(first & known & F.col("set_id").isNotNull(), top["copies"]).otherwise(1).alias("copies"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=2).select("doc_id", "n_shingles", "component_id", "kept")


def _mixed(members: DataFrame, component: DataFrame) -> DataFrame:
    """key, id, n, component, main: the members of buckets that hold several components, and the component that has most of each."""
    placed = durable(members.select("key", "id", "n").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    return durable(placed.join(main, "key"), "mixed")


def compare_blocks(rows: DataFrame, sets: DataFrame, per_cent: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between ids of different components under one main (rows: main, id, component, n): every id outside the main component
    is compared with every id of the main's rows, block against block, and one link for each component it reaches in a block is given. A
    block has about `block` sets and block_bytes at most, or one longer set."""
    outside = F.col("component") != F.col("main")
    number = lambda count, size: F.ceil(F.greatest(count / block, 8 * size / block_bytes)).cast("int")
    sizes = rows.groupBy("main").agg(number(F.count("*"), F.sum("n")).alias("rights"), number(F.count_if(outside), F.sum(F.when(outside, F.col("n")).otherwise(0))).alias("lefts"))
    dealt = rows.join(sizes, "main").withColumn("h", F.xxhash64("id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("component <> main").select("main", F.pmod("h", "lefts").cast("int").alias("l"), every("rights").alias("r"), F.lit(True).alias("left"), "id", "component")
    right = dealt.select("main", every("lefts").alias("l"), F.pmod("h", "rights").cast("int").alias("r"), F.lit(False).alias("left"), "id", "component")

    def run(table: pa.Table) -> pa.Table:
        is_left = table["left"].to_numpy().astype(bool)
        ids, parts, members = table["id"].to_numpy(), table["component"].to_numpy(), table["members"].to_pylist()
        right = np.flatnonzero(~is_left)
        a, b = [], []
        if len(right):
            arrays = [np.frombuffer(members[i], np.uint64) for i in right]
            flat, size = np.concatenate(arrays), np.array([len(x) for x in arrays])
            starts = np.cumsum(size) - size
            for i in np.flatnonzero(is_left).tolist():
                x = np.frombuffer(members[i], np.uint64)
                both = np.add.reduceat(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat, starts, dtype=np.int64)
                hit = right[(100 * both >= per_cent * (len(x) + size - both)) & (parts[right] != parts[i])]
                for j in hit[np.unique(parts[hit], return_index=True)[1]]:
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    with_sets = left.union(right).join(sets.select("id", "members"), "id")
    return with_sets.groupBy("main", "l", "r").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, registers, members (packed hashes) of wanted (id, doc_id, row, copies), from the texts of docs (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs, members = [], []
            for _, s in shingle_sets(batch.column(1), k):
                regs.append(registers(s).tobytes() if len(s) else None)
                members.append(s.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(regs, pa.binary()), pa.array(members, pa.binary())], ["id", "registers", "members"])

    build = lambda ids, texts: texts.join(ids.drop("copies"), ["doc_id", "row"]).select("id", "text").mapInArrow(run, "id long, registers binary, members binary")
    out = build(wanted.where("copies = 1"), docs)
    if wanted.where("copies > 1").limit(1).count():  # of repeated rows one is enough
        again = wanted.where("copies > 1")
        out = out.union(build(again, docs.join(again.select("doc_id", "row"), ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.first("text").alias("text"))))
    return out


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
