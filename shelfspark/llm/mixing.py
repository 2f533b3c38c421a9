"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the sources in which their text occurs (or a given list of sources). Token capacity flows from
patterns to source quotas: a pattern gives the tokens of its different texts once at cost 0, a second time at cost 1, and so on, so the
cheapest flow takes an overlapping text for the source that needs it most and repeats as little as possible. A class is what a pattern has
for one source (the rows of that source; or all its rows, if they belong to all sources of a given list); it gives at most `repeats` times
its tokens. A source that shares no pattern gets its target from its own class. Every shared pattern, however small or wide, takes part.
Up to 10 MAX_PATTERNS classes of shared patterns are solved on the driver (`route`), never documents; more stay in Spark (`route_in_tables`),
where the driver has one row a source and augments the flow along sums of many patterns until no path is left. Both give a flow of least cost.
Each class is then filled with documents in the order of a seeded hash.

Targets: every source gets its weight's share of all tokens, but no more than `repeats` times its own tokens; the excess is shared again by
weight among sources that are not at that limit.

Defined cases: null text has size 0 and is never taken (0 words); a null source is a source of its own, last in order; an empty table
gives no rows; repeated rows (same doc_id, text and source) take the same copies, and the flow counts each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

WEIGHTS, REPEATS, SEED, BINS = (5, 2, 1), 3, "mix", 4096
EPSILON = 1e-6
MAX_PATTERNS = 2_000  # patterns, of about ten classes each, that the driver solves; more are solved in Spark
ARCS = 100_000  # sums between sources, beside one a source, that one round of that takes to the driver; what is left out is met in a later round
SMALL = 20_000  # rows of a table that is broadcast
SPARE = -1  # in place of a source: tokens of a pattern that no source has taken


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, repeats: int = REPEATS) -> dict:
    """The quota of each source, given (source, tokens); weights repeat over sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: repeats * n for s, n in order}
    left, open_weight, out = float(sum(n for _, n in order)), sum(weight.values()), {}
    for s in sorted(weight, key=lambda s: (limit[s] / weight[s], s is None, (s or "").encode())):
        level = left / open_weight
        if limit[s] <= level * weight[s]:
            out[s] = float(limit[s])
            left, open_weight = left - limit[s], open_weight - weight[s]
        else:
            out |= {r: level * weight[r] for r in weight if r not in out}
            break
    return out


class _Network:
    """A small flow network: arcs with room; flow is pushed along shortest paths, all of one length at once."""

    def __init__(self) -> None:
        self.of: dict = {}
        self.arcs: list[list[int]] = []
        self.head: list[int] = []
        self.room: list[float] = []

    def node(self, name: object) -> int:
        if name not in self.of:
            self.of[name] = len(self.arcs)
            self.arcs.append([])
        return self.of[name]

    def arc(self, a: object, b: object, room: float) -> int:
        for x, y, r in ((a, b, room), (b, a, 0.0)):
            self.arcs[self.node(x)].append(len(self.head))
            self.head.append(self.node(y))
            self.room.append(r)
        return len(self.head) - 2

    def push(self, a: object, b: object) -> None:
        """The most that goes from a to b."""
        start, end = self.node(a), self.node(b)
        while True:
            level, queue = {start: 0}, [start]
            for x in queue:
                for e in self.arcs[x]:
                    if self.room[e] > EPSILON and self.head[e] not in level:
                        level[self.head[e]] = level[x] + 1
                        queue.append(self.head[e])
            if end not in level:
                return
            at, path = [0] * len(self.arcs), []
            while True:
                x = self.head[path[-1]] if path else start
                if x == end:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    path = path[: next(i for i, e in enumerate(path) if self.room[e] <= EPSILON)]
                elif at[x] < len(self.arcs[x]):
                    e = self.arcs[x][at[x]]
                    if self.room[e] > EPSILON and level.get(self.head[e]) == level[x] + 1:
                        path.append(e)
                    else:
                        at[x] += 1
                elif path:
                    at[self.head[path.pop() ^ 1]] += 1
                else:
                    break


def route(texts: dict[tuple, float], classes: dict[tuple, float], quota: dict, repeats: int = REPEATS) -> dict[tuple, float]:
    """Min-cost flow: the tokens taken from each class (pattern, sources it can serve), given the tokens of the different texts of each
    pattern, of each class, and the quotas.

    Patterns open in tiers of their texts, at costs 0, 1, 2, ...; a tier opens when nothing cheaper can meet a quota. The last tier is bounded
    by the classes alone, so every quota that they can meet is met."""
    net = _Network()
    opened = {p: net.arc("all", ("pattern", p), 0.0) for p in texts}
    given = {c: net.arc(("pattern", c[0]), ("class", c), repeats * n) for c, n in classes.items()}
    for p, homes in classes:
        for s in homes:
            net.arc(("class", (p, homes)), ("source", s), float("inf"))
    for s, n in quota.items():
        net.arc(("source", s), "met", n)
    for tier in range(1, repeats + 2):
        for p, e in opened.items():
            net.room[e] += texts[p] if tier <= repeats else float("inf")
        net.push("all", "met")
    return {c: net.room[e ^ 1] for c, e in given.items()}


def memberships(rows: DataFrame) -> DataFrame:
    """row, pattern, text_size of the texts (by hash) that occur in several sources. A pattern is named by the number of its sources and a sum
    of their hashes, so none is collected."""
    pairs = rows.groupBy("row", "source").agg(F.max("size").alias("size"))
    name = F.concat_ws(" ", F.count("*").cast("string"), F.hex(F.bit_xor(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))))
    return pairs.groupBy("row").agg(F.count("*").alias("n"), name.alias("pattern"), F.max("size").alias("text_size")).where("n > 1").drop("n")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _levels(flow: DataFrame, left: list[float], slack: list[float], least: float) -> dict[int, int] | None:
    """How many moves each source (and SPARE) is away from one that lacks tokens, up to the first spare ones; None if no spare tokens can
    get there. A source gives to another one tokens of a pattern that has both."""
    spark = flow.sparkSession
    level = {s: 0 for s, n in enumerate(left) if n > least}
    front, depth = list(level), 0
    while front:
        near = flow.join(_small(spark.createDataFrame([(s,) for s in front], "s int"), len(front)), "s").select("pattern").distinct()
        giving = {r.s for r in flow.where(F.col("x") > EPSILON).join(near, "pattern", "left_semi").select("s").distinct().collect()}
        depth += 1
        if SPARE in giving or any(slack[s] > least for s in front):
            return level | {SPARE: depth}
        front = [s for s in giving if s not in level]
        level |= {s: depth for s in front}
    return None


def _deal(open_: DataFrame, dealt: DataFrame) -> DataFrame:
    """pattern, s, to, moved: of the x tokens of patterns (pattern, s, to, x), the n of dealt (s, to, n), in the order of a hash: whole bins of
    it, then whole patterns of one bin, and a part of one."""
    rows = open_.join(dealt, ["s", "to"]).withColumn("bin", F.pmod(F.xxhash64("pattern"), F.lit(BINS)))
    upto = Window.partitionBy("s", "to").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.groupBy("s", "to", "bin").agg(F.sum("x").alias("inside")).withColumn("end", F.sum("inside").over(upto))
    rows = rows.join(bins, ["s", "to", "bin"]).where(F.col("end") - F.col("inside") < F.col("n"))
    here = Window.partitionBy("s", "to", "bin").orderBy("pattern").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.where("end > n").withColumn("at", F.col("end") - F.col("inside") + F.sum("x").over(here))
    part = part.withColumn("moved", F.least(F.col("x"), F.col("n") - (F.col("at") - F.col("x")))).where("moved > 0")
    out = ["pattern", "s", "to", "moved"]
    return rows.where("end <= n").withColumn("moved", F.col("x")).select(*out).union(part.select(*out))


def route_in_tables(members: DataFrame, texts: DataFrame, own: list[float], quota: list[float], repeats: int = REPEATS) -> tuple[DataFrame, list[float], list[float]]:
    """Min-cost flow as in `route`, for any number of patterns: members are pattern, s (place of a source in own and quota) of the shared
    patterns, texts are pattern, n (tokens of its different texts), own are the tokens that only one source has. Gives pattern, s, x (the
    tokens taken), those taken of own, and what each quota lacks when every pattern is taken `repeats` times.

    Tiers open as in `route`. In a tier, each pattern chooses one source that lacks tokens, or is nearest to one; the sums of what its spare
    tokens and its other sources can give make a network of sources, small enough for the driver; its largest flow is dealt out over whole
    patterns, at most one of each sum in part. Every source keeps a way to the lack, so each round gains, and rounds end when no way is left, that is when
    the flow of the tier is the largest one. The classes bound no tier but the last: a class has no fewer tokens than the pattern's texts."""
    spark, sources = members.sparkSession, len(quota)
    least = max(EPSILON, 1e-10 * sum(quota))
    left, used, turn = list(quota), [0.0] * sources, 0
    spare = texts.select("pattern", F.lit(SPARE).alias("s"), F.col("n").cast("double").alias("x"))
    flow = members.select("pattern", "s", F.lit(0.0).alias("x"))
    for tier in range(1, repeats + 1):
        for s in range(sources):
            more = min(left[s], tier * own[s] - used[s])
            left[s], used[s] = left[s] - more, used[s] + more
        flow = durable(flow.union(spare).groupBy("pattern", "s").agg(F.sum("x").alias("x")), "flow")
        while level := _levels(flow, left, slack := [tier * n - u for n, u in zip(own, used, strict=True)], least):
            turn += 1
            marks = _small(spark.createDataFrame([(s, n, left[s] if n == 0 else 1.0) for s, n in level.items()], "s int, level int, weight double"), len(level))
            # sources of one level are chosen at random, those that lack more more often
            drawn = -F.log((F.pmod(F.xxhash64("pattern", "s", F.lit(turn)), F.lit(1 << 40)) + 0.5) / (1 << 40)) / F.col("weight")
            chosen = flow.where(F.col("s") != SPARE).join(marks, "s").groupBy("pattern").agg(F.min(F.struct("level", drawn.alias("drawn"), "s")).alias("to"))
            open_ = flow.where(F.col("x") > EPSILON).join(marks, "s").join(chosen, "pattern").where(F.col("level") > F.col("to.level")).select("pattern", "s", F.col("to.s").alias("to"), "x")
            open_ = durable(open_, "open")
            # of spare tokens every sum (one a source at most), so one round reaches all that lack; of a source its largest ones
            largest = Window.partitionBy("s").orderBy(F.desc("n"), "to")
            sums = open_.groupBy("s", "to").agg(F.sum("x").alias("n")).withColumn("at", F.row_number().over(largest)).where((F.col("s") == SPARE) | (F.col("at") <= max(1, ARCS // sources)))
            net = _Network()
            arcs = {(r.s, r.to): net.arc(r.s, r.to, r.n) for r in sums.orderBy("s", "to").collect()}
            direct = {s: net.arc(SPARE, s, slack[s]) for s in range(sources) if slack[s] > 0}
            met = {s: net.arc(s, "met", left[s]) for s, n in level.items() if n == 0}
            net.push(SPARE, "met")
            gained = {s: net.room[e ^ 1] for s, e in met.items()}
            if sum(gained.values()) <= least:
                break
            for s, n in gained.items():
                left[s] -= n
            for s, e in direct.items():
                used[s] += net.room[e ^ 1]
            dealt = [(*k, net.room[e ^ 1] if net.room[e] > 0 else float("inf")) for k, e in arcs.items() if net.room[e ^ 1] > 0]
            if dealt:
                moved = _deal(open_, _small(spark.createDataFrame(dealt, "s int, to int, n double"), len(dealt)))
                flow = flow.union(moved.select("pattern", "s", -F.col("moved"))).union(moved.select("pattern", "to", "moved"))
                flow = durable(flow.groupBy("pattern", "s").agg(F.greatest(F.sum("x"), F.lit(0.0)).alias("x")), "flow")
    return flow.where(F.col("s") != SPARE), used, left


def _plan_in_tables(classes: DataFrame, texts: DataFrame, sizes: dict, quota: dict, repeats: int, by_source: bool) -> DataFrame:
    """class, class_size, tokens of classes (class, pattern, homes, size), from `route_in_tables`."""
    spark, names = classes.sparkSession, sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    ids = _small(spark.createDataFrame(list(enumerate(names)), "s int, source string"), len(names))
    placed = classes.select("class", "pattern", "size", F.explode("homes").alias("home"))
    placed = durable(placed.join(ids, F.col("home").eqNullSafe(F.col("source"))).select("class", "pattern", "size", "s"), "members")
    shared, alone = placed.where("pattern IS NOT NULL"), placed.where("pattern IS NULL")
    own = [0.0] * len(names)
    for r in alone.select("s", "size").collect():  # one row a source
        own[r.s] = float(r.size)
    flow, used, left = route_in_tables(shared.select("pattern", "s"), texts, own, [quota[s] for s in names], repeats)
    taken = shared.join(flow, ["pattern", "s"])
    if by_source and max(left) > 0:  # the last tier: what the repeated rows of classes have beyond their texts
        taken = durable(taken, "taken")
        room = taken.select("pattern", "s", F.col("s").alias("to"), (repeats * F.col("size") - F.col("x")).alias("x")).where("x > 0")
        more = _deal(room, _small(spark.createDataFrame([(s, s, n) for s, n in enumerate(left) if n > 0], "s int, to int, n double"), len(left))).select("pattern", "s", "moved")
        taken = taken.join(more, ["pattern", "s"], "left").withColumn("x", F.col("x") + F.coalesce("moved", F.lit(0.0)))
    # rounded, so that sums in another order choose the same documents
    taken = taken.groupBy("class").agg(F.first("size").alias("class_size"), F.round(F.sum("x"), 3).alias("tokens"))
    filled = _small(spark.createDataFrame([(s, round(n, 3)) for s, n in enumerate(used)], "s int, tokens double"), len(used))
    return durable(taken.union(alone.join(filled, "s").select("class", F.col("size").alias("class_size"), "tokens")), "plan")


def _plan_on_driver(classes: DataFrame, texts: DataFrame, quota: dict, repeats: int) -> tuple[DataFrame, int]:
    """class, class_size, tokens of classes (class, pattern, homes, size), from `route`; and their number."""
    of_texts = {r.pattern: float(r.n) for r in texts.collect()}
    found = {r["class"]: (r["pattern"], tuple(r["homes"]), r["size"]) for r in sorted(classes.collect(), key=lambda r: r["class"])}  # a row a source, and a bounded number of shared ones
    mixed = {s for p, serves, _ in found.values() if p is not None for s in serves}
    flow = {c: x for c, x in found.items() if mixed.intersection(x[1])}
    tokens = {c: 0.0 if c in flow else quota[serves[0]] for c, (_, serves, _) in found.items()}
    flows = {(p if p is not None else serves, serves): n for p, serves, n in flow.values()}
    routed = route({p: of_texts.get(p, float(n)) for (p, _), n in flows.items()}, flows, {s: quota[s] for s in mixed}, repeats)
    tokens |= {c: routed[p if p is not None else serves, serves] for c, (p, serves, _) in flow.items()}
    plan = classes.sparkSession.createDataFrame([(c, n, float(tokens[c])) for c, (_, _, n) in found.items()], "class string, class_size long, tokens double")
    return plan, len(found)


def mix(docs: DataFrame, patterns: Column | None = None, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, quotas) of a mix: rows are doc_id, row (a hash of the text), source, pattern, size, copies (how often the mix takes the row);
    quotas are source, source_size, target.

    patterns: an array column of the sources that a document belongs to (null: the null source), any of which it can serve; without it,
    a document serves its `source`, and its pattern is the sources of its text (null: no other).
    """
    spark = docs.sparkSession
    given = F.coalesce(F.array_sort(F.array_distinct(patterns)), F.array(F.lit(None).cast("string"))) if patterns is not None else F.array(F.col("source").cast("string"))
    rows = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("source").cast("string").alias("source"), given.alias("homes"), n_words(F.col("text")).alias("size"))
        .withColumn("rank", F.xxhash64(F.lit(seed), "doc_id", "row"))
        .withColumn("bin", F.pmod("rank", F.lit(BINS)).cast("int")),
        "sizes",
    )
    if patterns is None:
        shared = durable(memberships(rows), "memberships")
        rows = rows.join(shared.drop("text_size"), "row", "left")
        rows = durable(rows.withColumn("class", F.to_json(F.struct("pattern", "homes"))), "rows")
    else:
        rows = rows.withColumn("pattern", F.when(F.size("homes") > 1, F.to_json("homes")))
        rows = durable(rows.withColumn("class", F.to_json(F.struct("homes"))), "rows")
    classes = durable(rows.groupBy("class").agg(F.first("pattern").alias("pattern"), F.first("homes").alias("homes"), F.sum("size").alias("size")), "classes")
    rows = rows.drop("homes")
    sizes = {r.home: r.n for r in classes.select(F.explode("homes").alias("home"), "size").groupBy("home").agg(F.sum("size").alias("n")).collect()}  # a row a source
    quota = targets(list(sizes.items()), weights, repeats)
    texts = shared.groupBy("pattern").agg(F.sum("text_size").alias("n")) if patterns is None else classes.where("pattern IS NOT NULL").select("pattern", F.col("size").alias("n"))
    if classes.where("pattern IS NOT NULL").count() > 10 * MAX_PATTERNS:
        plan, n_classes = _plan_in_tables(classes, texts, sizes, quota, repeats, patterns is None), None
    else:
        plan, n_classes = _plan_on_driver(classes, texts, quota, repeats)
    small = F.broadcast if n_classes is not None and n_classes <= SMALL else lambda df: df

    # whole rounds first; of the last round, whole bins of the hash order, then single documents of one bin
    bins = rows.groupBy("class", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    bins = bins.join(small(plan), "class").select("class", "bin", "bin_size", "before", (F.floor(F.col("tokens") / F.greatest("class_size", F.lit(1)))).alias("rounds"), "class_size", "tokens")
    bins = bins.withColumn("rest", F.col("tokens") - F.col("rounds") * F.col("class_size"))
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest"))
    bins = bins.select("class", "bin", "before", "rest", "rounds", edge.alias("edge"), (F.col("before") + F.col("bin_size") <= F.col("rest")).alias("inside"))
    placed = rows.join(bins, ["class", "bin"])
    within = Window.partitionBy("class", "bin").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.where("edge").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("more", (F.col("at") + F.col("size") / 2 <= F.col("rest")).cast("int"))
    keep = ["doc_id", "row", "source", "pattern", "size"]
    copies = F.least(F.col("rounds") + F.col("more"), F.lit(repeats))
    chosen = at_edge.select(*keep, copies.cast("long").alias("copies")).union(
        placed.where("NOT edge").withColumn("more", F.col("inside").cast("int")).select(*keep, copies.cast("long").alias("copies")))
    quotas = spark.createDataFrame([(s, sizes[s], quota[s]) for s in quota], "source string, source_size long, target double")
    return chosen, _small(quotas, len(quota))


def mix_by_source(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    chosen, quotas = mix(docs)
    return chosen.join(quotas, chosen["source"].eqNullSafe(quotas["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), chosen["source"], "copies"
    )
