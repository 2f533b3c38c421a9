"""Exact metric range join for embedding near-duplicates.

Vectors are scaled to length 1, so cosine >= c is distance <= r = sqrt(2 - 2c). Equal unit vectors form a class with one representative.
Pivots, a sample of representatives that grows with their number, cut the space into cells (nearest pivot), and each cell's radius is
counted. A vector y meets cell i unless the triangle inequality rules all members of i out, by the cell's radius, d(y,i) > radius(i) + r, or
by its distance to the border between i and its own cell, (d(y,i)^2 - d(y,own)^2) / (2 d(i,own)) > r. The members of a cell are packed into
blocks, one row a block, written once. Two blocks are compared, once for both directions, if each has a vector that meets the other's cell,
and then only such vectors are. Each task of this join reads some blocks of both sides where they are written: no vector is copied or
shuffled for it, so disk stays in proportion to the vectors however many cells they meet. A task reports link counts and, for components,
the smallest id that each of its vectors reaches in a pair of blocks.

How much the triangle inequality prunes depends on the data: tight clusters are ruled out by their radius, while vectors that are spread
evenly over many dimensions lie within reach of most cells, and then the exact join compares nearly all pairs.

Defined cases: null, zero, non-finite or null-holding vectors link with nothing, vectors of different lengths not with each other (a length
without a pivot is one cell); a null vec_id has no component and is kept; rows with equal vec_id share a component; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions
from .components import connected

BLOCK, EDGE = 2048, 1e-9
#: More than the rounding error of a squared distance of unit vectors.
ROUNDING = 1e-12


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, size, unit (packed doubles), raw (packed doubles) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)  # a null component spoils its vector as nan does
            first, known = np.cumsum(sizes) - sizes, pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                row = np.flatnonzero((sizes == size) & known)
                x = values[first[row][:, None] + np.arange(size)]
                scale = np.abs(x).max(1, initial=0)
                good = np.isfinite(scale) & (scale > 0)
                x = x[good] / scale[good][:, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[good])), pa.array(np.full(len(x), size, np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "size", "unit"]
                )

    return rows.mapInArrow(run, "vec_id long, size int, unit binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _apart(units: list[bytes]) -> np.ndarray:
    """The vectors without those that rounding hardly tells from an earlier one (scaled copies)."""
    kept: list[np.ndarray] = []
    for x in (np.frombuffer(u, np.float64) for u in dict.fromkeys(units)):
        if not kept or ((np.stack(kept) - x) ** 2).sum(1).min() > ROUNDING:
            kept.append(x)
    return np.stack(kept)


def at_home(reps: DataFrame, pivots: Broadcast) -> DataFrame:
    """size, cell, near (distance to the cell's pivot), id, unit, copies: each representative in the cell of its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, p in _by_size(batches, 0, 2, pivots.value):
            d = _distances(x, p) if len(p) else np.zeros((len(x), 1))
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own]), *(part.column(i) for i in (1, 2, 3))], ["size", "cell", "near", "id", "unit", "copies"])

    return reps.select("size", "id", "unit", "copies").mapInArrow(run, "size int, cell int, near double, id long, unit binary, copies long")


def _meets(x: np.ndarray, own: np.ndarray, near: np.ndarray, pivots: np.ndarray, radii: np.ndarray, radius: float, cells: np.ndarray) -> np.ndarray:
    """Which of cells (columns) may have members within radius of the vectors x (rows), which lie in the cells own, near their pivots."""
    if not len(pivots):
        return np.ones((len(x), len(cells)), bool)
    d = _distances(x, pivots[cells])
    # multiplied out, with all rounding errors in favour of meeting: pivots may be (nearly) equal
    named, at = np.unique(own, return_inverse=True)
    apart = np.sqrt(_distances(pivots[named], pivots[cells]) ** 2 + ROUNDING)
    meets = d**2 - near[:, None] ** 2 <= 2 * apart[at] * (radius + EDGE) + ROUNDING
    return meets & (d <= radii[cells] + radius + EDGE) | (own[:, None] == cells)


def dealt(homes: DataFrame, pivots: Broadcast, radii: Broadcast, radius: float) -> DataFrame:
    """size, cell, home, id, unit, copies: each representative in its own cell (home) and in each cell that may have members within radius.
    The join itself does not make these rows: their number tells how much the triangle inequality prunes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, p in _by_size(batches, 0, 4, pivots.value):
            own, size = part.column(1).to_numpy(), int(part.column(0)[0].as_py())
            row, cell = np.nonzero(_meets(x, own, part.column(2).to_numpy(), p, radii.value.get(size), radius, np.arange(max(len(p), 1))))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(own[row] == cell), *(part.column(i).take(pa.array(row)) for i in (3, 4, 5))],
                ["size", "cell", "home", "id", "unit", "copies"],
            )

    return homes.mapInArrow(run, "size int, cell int, home boolean, id long, unit binary, copies long")


PACKED = "size int, cell int, b int, meets array<int>, ids binary, near binary, units binary, copies binary"


def packed(homes: DataFrame, pivots: Broadcast, radii: Broadcast, radius: float, block: int) -> DataFrame:
    """A row for each block of about `block` vectors of a cell, with the cells that one of its vectors meets."""

    def run(table: pa.Table) -> pa.Table:
        size, cell, b = (table[c][0].as_py() for c in ("size", "cell", "b"))
        p, near, n = pivots.value.get(size, np.zeros((0, size))), table["near"].to_numpy(), table.num_rows
        meets = np.zeros(max(len(p), 1), bool)
        for lo in range(0, n, BLOCK):
            x = _matrix(table["unit"].slice(lo, BLOCK))
            meets |= _meets(x, np.full(len(x), cell), near[lo : lo + BLOCK], p, radii.value.get(size), radius, np.arange(len(meets))).any(0)
        raw = [table["id"].to_numpy().tobytes(), near.tobytes(), b"".join(table["unit"].to_pylist()), table["copies"].to_numpy().tobytes()]
        columns = [pa.array([size], pa.int32()), pa.array([cell], pa.int32()), pa.array([b], pa.int32()), pa.array([np.flatnonzero(meets)], pa.list_(pa.int32())), *(pa.array([r], pa.binary()) for r in raw)]
        return pa.Table.from_arrays(columns, ["size", "cell", "b", "meets", "ids", "near", "units", "copies"])

    spark = homes.sparkSession
    cells = homes.groupBy("size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = homes.join(cells, ["size", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    return rows.repartition(partitions(spark), "size", "cell", "b").groupBy("size", "cell", "b").applyInArrow(run, PACKED)


def _by_size(batches: Iterator[pa.RecordBatch], size_at: int, unit_at: int, pivots: dict) -> Iterator[tuple]:
    """The rows of one vector length at a time, at most BLOCK, their vectors and that length's pivots."""
    for batch in batches:
        sizes = batch.column(size_at).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for lo in range(0, len(at), BLOCK):
                part = batch.take(pa.array(at[lo : lo + BLOCK]))
                yield part, _matrix(part.column(unit_at)), pivots.get(int(size), np.zeros((0, size)))


def _smallest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (ids a) and column (ids b) of a link matrix reaches through it."""
    top = np.iinfo(np.int64).max
    to_a, to_b = a.copy(), b.copy()
    while True:
        by_b = np.minimum(to_b, np.where(linked, to_a[:, None], top).min(0, initial=top))
        by_a = np.minimum(to_a, np.where(linked, by_b[None, :], top).min(1, initial=top))
        if (by_a == to_a).all() and (by_b == to_b).all():
            return to_a, to_b
        to_a, to_b = by_a, by_b


def join_block(x: np.ndarray, a: np.ndarray, copies_a: np.ndarray, y: np.ndarray, b: np.ndarray, copies_b: np.ndarray, cosine: float, step: int) -> Iterator[pa.RecordBatch]:
    """Of two sets of vectors without common members, or of one with itself (y is x): id, links (sum of class sizes), reaches."""
    for lo in range(0, len(x), step):
        for to in range(lo if y is x else 0, len(y), step):
            left, right, same = slice(lo, lo + step), slice(to, to + step), y is x and lo == to
            linked = (x[left] @ y[right].T >= cosine) & (a[left][:, None] != b[right][None, :])
            if same:
                linked |= linked.T
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(rows):
                continue
            linked, ids_a, ids_b = linked[np.ix_(rows, cols)], a[left][rows], b[right][cols]
            links_a = linked @ copies_b[right][cols].astype(np.float64)
            links_b = np.zeros(len(cols)) if same else copies_a[left][rows].astype(np.float64) @ linked
            to_a, to_b = _smallest(linked, ids_a, ids_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in ((ids_a, ids_b), (links_a.astype(np.int64), links_b.astype(np.int64)), (to_a, to_b))], ["id", "links", "reaches"])


def joined(blocks: DataFrame, pivots: Broadcast, radii: Broadcast, radius: float, cosine: float, step: int) -> DataFrame:
    """id, links, reaches, over all pairs of blocks whose cells meet."""

    def unpack(batch: pa.RecordBatch, i: int, side: str) -> dict:
        raw = lambda c, kind: np.frombuffer(batch.column(f"{c}_{side}")[i].as_buffer(), kind)
        size, cell, b = (batch.column(f"{c}_{side}")[i].as_py() for c in ("size", "cell", "b"))
        return {"size": size, "cell": cell, "b": b, "ids": raw("ids", np.int64), "near": raw("near", np.float64), "x": raw("units", np.float64).reshape(-1, size), "copies": raw("copies", np.int64)}

    def meeting(one: dict, cell: int) -> tuple:
        p = pivots.value.get(one["size"], np.zeros((0, one["size"])))
        at = np.flatnonzero(_meets(one["x"], np.full(len(one["x"]), one["cell"]), one["near"], p, radii.value.get(one["size"]), radius, np.array([cell]))[:, 0])
        return one["x"][at], one["ids"][at], one["copies"][at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = unpack(batch, i, "l"), unpack(batch, i, "r")
                if (left["cell"], left["b"]) == (right["cell"], right["b"]):
                    own = left["x"], left["ids"], left["copies"]
                    yield from join_block(*own, *own, cosine, step)
                else:
                    yield from join_block(*meeting(left, right["cell"]), *meeting(right, left["cell"]), cosine, step)

    side = lambda x: blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns])
    order = lambda x: F.struct(F.col(f"cell_{x}").alias("cell"), F.col(f"b_{x}").alias("b"))
    meet = (F.col("size_l") - F.col("size_r") == 0) & (order("l") <= order("r")) & F.array_contains("meets_l", F.col("cell_r")) & F.array_contains("meets_r", F.col("cell_l"))
    # every task reads its part of both sides from the written blocks: an equi-join would shuffle a copy of a block for each partner
    pairs = side("l").hint("shuffle_replicate_nl").crossJoin(side("r")).where(meet)
    return pairs.drop("meets_l", "meets_r").mapInArrow(run, "id long, links long, reaches long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, n_pivots: int | None = None, block: int = BLOCK, slice_: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    block: vectors in a packed row; slice_: vectors of each side in one product of matrices.
    n_pivots: by default one for each block of representatives, but 4 times the root of their number at most, so what the driver holds
    grows with the root of the input."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = durable(unit_vectors(rows), "units")
    # one number stands for one unit vector from here on
    reps = durable(units.groupBy("size", "unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "reps")
    radius, n = float(np.sqrt(2 - 2 * cosine)), reps.count()
    n_pivots = n_pivots or math.ceil(min(n / block, 4 * math.sqrt(n))) or 1
    picked: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("size", "unit").collect():
        picked.setdefault(r["size"], []).append(bytes(r["unit"]))
    found = {size: _apart(us) for size, us in picked.items()}
    pivots = spark.sparkContext.broadcast(found)
    homes = at_home(reps, pivots)
    radii = {size: np.zeros(len(p)) for size, p in found.items()}
    for r in homes.where(F.col("size").isin(list(found))).groupBy("size", "cell").agg(F.max("near").alias("radius")).collect():  # a row a pivot at most
        radii[r["size"]][r["cell"]] = r["radius"]
    shared = spark.sparkContext.broadcast(radii)
    blocks = durable(packed(homes, pivots, shared, radius, block), "blocks")
    found = durable(joined(blocks, pivots, shared, radius, cosine, slice_), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> reaches").select(F.col("id").alias("a"), F.col("reaches").alias("b")).distinct()
    component = connected(edges)
    named = reps.select("size", "unit", "id", "copies").join(links, "id", "left").join(component, "id", "left")
    classes = units.join(named, ["size", "unit"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    classes = classes.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(classes, "vec_id", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))


def brute_force(vectors: list[tuple[int, list | None]], cosine: float = 0.9) -> list[tuple]:
    """The same result by all pairs, for tests with distinct ids."""
    good = [(i, np.asarray(v, float)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    links: dict = {i: set() for i, _ in vectors}
    for i, x in good:
        for j, y in good:
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
    out = []
    for i in links:
        seen, queue = {i}, [i]
        for k in queue:
            queue += [m for m in links[k] if m not in seen]
            seen |= links[k]
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE array_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT v.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN r ON r.id = v.vec_id GROUP BY v.vec_id
"""
