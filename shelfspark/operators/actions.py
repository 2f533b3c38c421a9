"""The recommendation action log: current state as a fold over events; outcomes and supplier scores; throttling."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rec_state(actions: DataFrame, keys: list[str], decided: bool = False) -> DataFrame:
    """keys, approved, dismissed, edited_quantity, order_placed, outcome (and decided: the place of the latest approve, dismiss or unapprove):
    the latest event of each field by (ts, event_id).

    An approve or dismiss event sets both flags; an edit of a negative value is void, and one of 0 takes the edit back."""
    latest = lambda kind, value: F.max_by(F.when(kind, value), F.when(kind, F.struct("ts", "event_id")))
    decision = F.col("action").isin("approve", "dismiss", "unapprove")
    last = latest(decision, F.col("action"))
    out = actions.groupBy(*keys).agg(
        (last == "approve").alias("approved"), (last == "dismiss").alias("dismissed"), latest((F.col("action") == "edit") & (F.col("value") >= 0), F.col("value")).alias("edit"),
        F.coalesce(latest(F.col("action") == "order_placed", F.lit(True)), F.lit(False)).alias("order_placed"), latest(F.col("action") == "outcome", F.when(F.col("value") > 0, "avoided").otherwise("happened")).alias("outcome"),
        *([F.max(F.when(decision, F.struct("ts", "event_id"))).alias("decided")] if decided else []),
    )
    return out.withColumns({"approved": F.coalesce("approved", F.lit(False)), "dismissed": F.coalesce("dismissed", F.lit(False)), "edit": F.nullif("edit", F.lit(0.0))}).withColumnRenamed("edit", "edited_quantity")


def outcome_stats(state: DataFrame, by: str) -> DataFrame:
    """Per group: recs, approved, placed, avoided, happened, pending outcome, follow-through and success in per cent (0 without cases)."""
    placed = F.col("order_placed")
    n = state.groupBy(by).agg(
        F.count("*").alias("recs"), F.count_if("approved").alias("approved"), F.count_if(placed).alias("placed"), F.count_if(F.col("outcome") == "avoided").alias("avoided"),
        F.count_if(F.col("outcome") == "happened").alias("happened"), F.count_if(placed & F.col("outcome").isNull()).alias("pending"),
    )
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(100 * a, b), 1), F.lit(0.0))
    return n.withColumn("follow_through", share(F.col("placed"), F.col("approved"))).withColumn("success", share(F.col("avoided"), F.col("avoided") + F.col("happened")))


def supplier_scores(state: DataFrame, delays: DataFrame) -> DataFrame:
    """supplier, score: 50, plus 20 times orders placed per approval, plus 30 times stockouts avoided, minus 10 for delays over 0.3."""
    n = outcome_stats(state, "supplier").join(delays, "supplier", "left")
    part = lambda w, a, b: F.coalesce(w * F.try_divide(a, b), F.lit(0.0))
    score = 50 + part(20, F.col("placed"), F.col("approved")) + part(30, F.col("avoided"), F.col("avoided") + F.col("happened")) - F.when(F.col("delay") > 0.3, 10).otherwise(0)
    return n.select("supplier", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("score"), "approved", "placed")


def throttled(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, key, hits, exceeded: hits of a key in the window (ts - seconds, ts], ties in time included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("key").orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.select("event_id", "key", F.count("*").over(window).alias("hits")).withColumn("exceeded", F.col("hits") > limit)


def lockouts(events: DataFrame, limit: int = 5, seconds: int = 900) -> DataFrame:
    """event_id, key, failures, locked, unlock_in: failures of a key since its last success, in the trailing window."""
    order = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    epoch = events.withColumn("epoch", F.sum(F.col("success").cast("int")).over(order)).where("NOT success")
    window = Window.partitionBy("key", "epoch").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    out = epoch.select("event_id", "key", "ts", F.count("*").over(window).alias("failures"), F.min("ts").over(window).alias("oldest")).withColumn("locked", F.col("failures") >= limit)
    left = F.lit(seconds) - (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("oldest").cast("timestamp")))
    return out.select("event_id", "key", "failures", "locked", F.when(F.col("locked"), left).alias("unlock_in"))


NOTE = 500
# Settings of an organisation that has set none.
COMPANY_DEFAULTS = {"lead_days": 56, "stockout_cost": 50.0, "holding_cost": 2.0, "service_level": 0.95, "lead_variance": 7, "industry": "general", "description": ""}


def bulk(log: DataFrame, now: DataFrame, sessions: Column, undone: Column) -> DataFrame:
    """State (by session_id, item_no) after a bulk approval, at the end of the chosen sessions, of items that are neither approved nor dismissed,
    and an undo of some of these: both are expanded to events of single items and folded with the rest."""
    ends = log.where(sessions).groupBy("session_id").agg(F.max("ts").alias("ts"))
    items = now.where("NOT dismissed AND NOT approved").select("session_id", "item_no").join(ends, "session_id")
    event = lambda rows, action, n: rows.select("session_id", "item_no", F.lit(action).alias("action"), F.lit(None).cast("double").alias("value"), "ts", F.lit(2**62 + n).alias("event_id"))
    return rec_state(log.unionByName(event(items, "approve", 0)).unionByName(event(items.where(undone), "unapprove", 1)), ["session_id", "item_no"])


def with_bulk(state: DataFrame, bulk: DataFrame) -> DataFrame:
    """state (by session_id, item_no, with decided) after the latest bulk approval of each session (bulk: the place of the event): it approves
    what is neither approved nor dismissed, and what was decided later stays so."""
    both = state.join(bulk, "session_id", "left")
    taken = ~F.col("approved") & ~F.col("dismissed") & F.col("bulk").isNotNull() & (F.col("decided").isNull() | (F.col("bulk") > F.col("decided")))
    return both.withColumn("approved", F.col("approved") | taken).drop("decided", "bulk")


def texts(edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, note (cut to NOTE characters), edited_supplier (null where it is the suggested one): the latest of each."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    return edits.groupBy(*keys).agg(F.substring(last("note"), 1, NOTE).alias("note"), F.nullif(last("supplier"), last("suggested")).alias("edited_supplier"))


def upsert(writes: DataFrame, keys: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """keys, field, value: the latest write of each field that may be written."""
    return writes.where(F.col("field").isin(*allowed)).groupBy(*keys, "field").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def with_defaults(names: DataFrame, settings: DataFrame, key: str, defaults: dict) -> DataFrame:
    """names with their settings, each field else its default."""
    kinds = {f.name: f.dataType for f in settings.schema.fields}
    return names.join(settings, key, "left").select(key, *[F.coalesce(c, F.lit(v).cast(kinds[c])).alias(c) for c, v in defaults.items()])


def stale(runs: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """runs (state, started, swept) with those failed that have been analysing for longer, or that a restart found."""
    late = (F.col("state") == "analyzing") & ((F.unix_timestamp(as_of) - F.unix_timestamp("started") > seconds) | F.col("swept"))
    return runs.withColumn("state", F.when(late, "failed").otherwise(F.col("state")))


def supplier_accuracy(outcomes: DataFrame, sessions: DataFrame, as_of: datetime.date, days: int = 90) -> DataFrame:
    """org, supplier, total, approved, dismissed of outcomes (session_id, supplier, approved, dismissed, created) of the last days."""
    recent = outcomes.where(F.col("created") >= F.date_sub(F.lit(as_of), days)).join(sessions, "session_id")
    return recent.groupBy("org", "supplier").agg(F.count("*").alias("total"), F.count_if("approved").alias("approved"), F.count_if("dismissed").alias("dismissed"))


def clone(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Of each table the rows of the sessions in pairs (session_id, new_id), under the new number."""
    return {name: t.join(pairs, "session_id").select(F.col("new_id").alias("session_id"), *[c for c in t.columns if c != "session_id"]) for name, t in tables.items()}
