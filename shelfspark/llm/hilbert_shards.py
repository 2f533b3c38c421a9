"""Sharding along a Hilbert curve (DataFrame functions only).

Each document's metadata (source, language, size) is quantised to 2^ORDER steps a dimension and mapped to its Hilbert index, so documents
that are near in all dimensions are near on the curve. The order (curve index, text hash, doc_id) is cut into shards of near equal bytes:
a file then covers a small box of the metadata space, and min/max statistics prune it by any dimension.

Equal texts are one group: they take the curve index of the group's smallest (source, lang) and stay in one shard; only a group that no
shard could hold (more bytes than a shard's share) is cut like other rows. Large groups (over 1/LARGE of a share; at most LARGE times the
number of shards) are put into shards first, largest first, each where most room is; the curve is then cut to the room that is left, so
shards stay near equal. In a shard, rows of the curve come first.

Positions come from a range partitioning: each partition sums its bytes, the sums of partitions are added up, and rows count on from there.

Defined cases: null text has size 1 and crc32 0; null source or language counts as an empty one; null doc_id sorts first; repeated rows
stand next to each other; an empty table gives no rows; other columns are ignored; columns added here replace none of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions

ORDER, SHARDS, LARGE = 6, 8, 16


def hilbert_index(dims: list[Column], order: int = ORDER) -> Column:
    """The position of a point (each coordinate of `order` bits) on the Hilbert curve through the cube.

    The state of the walk is (entry corner e, direction d) of the current sub-cube; each step reads one bit of every coordinate, most
    significant first, and appends the Gray-code rank of the sub-cube that holds the point. A fold over bit levels carries the state.
    """
    n = len(dims)
    full = (1 << n) - 1
    level = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftrightunsigned(c, order - 1 - i).bitwiseAND(1), j) for j, c in enumerate(dims)])
    right = lambda x, k: F.expr("0") if k is None else (F.shiftrightunsigned(x, k).bitwiseOR(F.shiftleft(x, n - k))).bitwiseAND(full)

    def turn(x: Column, d: Column, left: bool) -> Column:
        out = x
        for k in range(1, n):
            out = F.when(d == k, right(x, n - k if left else k)).otherwise(out)
        return out

    ranks = {g ^ (g >> 1): g for g in range(1 << n)}  # of Gray codes
    entry = [0 if w == 0 else (2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2) >> 1) for w in range(1 << n)]
    trailing = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  ones at the end
    move = [0 if w == 0 else trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n for w in range(1 << n)]
    look = lambda values, at: F.get(F.array(*map(F.lit, values)), at)

    def step(state: Column, bits: Column) -> Column:
        e, d = state["e"], state["d"]
        spin = F.when(d + 1 == n, F.lit(0)).otherwise(d + 1)
        w = look([ranks[g] for g in range(1 << n)], turn(bits.bitwiseXOR(e), spin, left=False))
        next_e = e.bitwiseXOR(turn(look(entry, w), spin, left=True))
        next_d = (d + look(move, w) + 1) % n
        return F.struct(next_e.cast("int").alias("e"), next_d.cast("int").alias("d"), (state["h"] * (1 << n) + w).cast("long").alias("h"))

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[level(i).cast("int") for i in range(order)]), start, step, lambda s: s["h"])


def quantised(docs: DataFrame, order: int = ORDER) -> list[Column]:
    """source, lang and size as steps: names by their leading hash bits (pruning is by equality), sizes by half powers of two."""
    step = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(1 << order)).cast("int")
    return [step("source"), step("lang"), F.least(F.floor(2 * F.log2(F.col("size"))), F.lit((1 << order) - 1)).cast("int")]


def shard(docs: DataFrame, shards: int = SHARDS, order: int = ORDER) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot for each row of docs (doc_id, text, source, lang); row (a hash of the text) tells
    rows with equal doc_id apart."""
    n = partitions(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("row"),
    )
    rows = durable(rows.withColumn("point", F.struct(*[c.alias(x) for c, x in zip(quantised(rows, order), "xyz", strict=True)])), "rows")
    same = ["row", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.min("point").alias("at"), F.sum("size").alias("group_size"))
    groups = durable(groups.withColumn("curve", hilbert_index([F.col("at.x"), F.col("at.y"), F.col("at.z")], order)).drop("at"), "groups")
    share = (groups.agg(F.sum("group_size")).first()[0] or 0) / shards
    homes, room = _homes(groups.where((F.col("group_size") > share / LARGE) & (F.col("group_size") <= share)), share, shards)  # at most shards * LARGE
    homes = docs.sparkSession.createDataFrame(homes, "row long, text_crc32 long, size long, home int")
    groups = groups.join(F.broadcast(homes), same, "left")
    placed = rows.join(groups, same).repartitionByRange(n, "curve", "row", "text_crc32", "doc_id", "source", "lang").withColumn("part", F.spark_partition_id())
    placed = durable(placed.select("part", "doc_id", *same, "curve", "group_size", "home", "source", "lang"), "placed")

    # positions along the curve, of what is not put into shards already
    weight = F.when(F.col("home").isNull(), F.col("size")).otherwise(0)
    parts = placed.groupBy("part").agg(F.sum(weight).alias("part_size"))  # one row a partition
    before = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(before()), F.lit(0)).alias("base"))
    order_by = ["curve", "row", "text_crc32", "doc_id", "source", "lang"]
    to_here = Window.partitionBy("part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(F.broadcast(parts), "part").select(placed["*"], (F.col("base") + F.sum(weight).over(to_here) - weight).alias("start"))
    at = durable(at, "at")
    first = durable(at.groupBy(*same).agg(F.min("start").alias("group_start")), "first")
    whole = F.col("group_size") <= share
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    cuts = [sum(room[: i + 1]) for i in range(shards - 1)]
    along = sum(((F.col("middle") >= c).cast("int") for c in cuts), F.lit(0))
    cut = durable(at.join(first, same).withColumn("middle", middle).withColumn("shard", F.coalesce("home", along).cast("int")).withColumn("late", F.col("home").isNotNull()).drop("middle"), "cut")
    # slots: rows of a shard in this order of (late, part, row)
    counts = cut.groupBy("shard", "late", "part").agg(F.count("*").alias("n"))  # a row for each shard and partition
    bases = counts.select("shard", "late", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("late", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "shard", "late").orderBy(*order_by)
    return cut.join(F.broadcast(bases), ["shard", "late", "part"]).select("doc_id", "row", "size", "text_crc32", "curve", "shard", (F.col("base") + F.row_number().over(inside) - 1).alias("slot"))


def _homes(large: DataFrame, share: float, shards: int) -> tuple[list[tuple], list[float]]:
    """(row, text_crc32, size, shard) of each large group, and the room that is left in each shard."""
    room, out = [share] * shards, []
    for g in sorted(large.collect(), key=lambda g: (-g.group_size, g.row, g.text_crc32)):
        best = max(range(shards), key=lambda i: (room[i], -i))
        if room[best] >= g.group_size / 2:  # else it stays on the curve
            room[best] -= g.group_size
            out.append((g.row, g.text_crc32, g.size, best))
    spare = sum(x for x in room if x > 0) or 1.0
    over = -sum(x for x in room if x < 0)
    return out, [max(x, 0.0) * (1 - over / spare) for x in room]


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
