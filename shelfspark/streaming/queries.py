"""Streams over the action log, run to the end of what is there, with batch twins as their truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import actions
from shelfspark.operators.durable import new_folder
from shelfspark.plans.register import Register

from . import hits

REGISTER = query = Register()


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A file stream over a table's Parquet files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")


FILES, JITTER = 6, 3600


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of FILES micro-batches in which they come up to JITTER seconds late: each file holds a stretch of arrival
    times, and files are written one after the other."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    came = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(JITTER))
    span = e.agg(F.min(came).alias("a"), (F.max(came) + 1).alias("b")).first()
    path, schema = new_folder(spark, "arriving"), e.schema
    part = F.floor((came - span["a"]) * FILES / (span["b"] - span["a"])) if span["a"] is not None else F.lit(0)
    for i in range(FILES):
        e.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df: DataFrame, keys: list[str]) -> DataFrame:
    """What a stream gives once all available input is processed: each micro-batch appends its changed rows to a table beside the stream's
    checkpoint, and the last of a key counts. Nothing passes through the driver."""
    root = new_folder(df.sparkSession, "stream")

    def append(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")  # a repeated batch replaces itself

    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(hits.PROVIDER, None)
    conf.set(hits.PROVIDER, hits.ROCKS)
    try:
        q = df.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(append).start()
        q.awaitTermination()
    finally:
        conf.set(hits.PROVIDER, was) if was else conf.unset(hits.PROVIDER)
    fields = [c for c in df.columns if c not in keys]
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in fields])


# Events of the log with bulk approvals of whole sessions and undos among them.
ACTIONS = """WITH a AS (SELECT user_id % 20 AS session_id, event_id % 500 AS item_no, CASE WHEN event_id % 97 = 0 THEN 'approve_all' WHEN event_id % 11 = 0 THEN 'unapprove' ELSE CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'dismiss' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'order_placed' ELSE 'outcome' END END AS action, value, struct_pack(ts := ts, event_id := event_id) AS t FROM events),
b AS (SELECT session_id, max(t) AS bulk FROM a WHERE action = 'approve_all' GROUP BY ALL),
i AS (SELECT session_id, item_no, arg_max(action, t) FILTER (action IN ('approve', 'dismiss', 'unapprove')) AS last, max(t) FILTER (action IN ('approve', 'dismiss', 'unapprove')) AS decided, nullif(arg_max(value, t) FILTER (action = 'edit' AND value >= 0), 0) AS edited_quantity,
  bool_or(action = 'order_placed') AS order_placed, arg_max(CASE WHEN value > 0 THEN 'avoided' ELSE 'happened' END, t) FILTER (action = 'outcome') AS outcome FROM a WHERE action <> 'approve_all' GROUP BY ALL)"""


@query("rec_state_stream", f"""{ACTIONS} SELECT session_id, item_no, coalesce(last = 'approve', false) OR (coalesce(last, 'unapprove') = 'unapprove' AND bulk IS NOT NULL AND (decided IS NULL OR bulk > decided)) AS approved, coalesce(last = 'dismiss', false) AS dismissed, edited_quantity, order_placed, outcome FROM i LEFT JOIN b USING (session_id)""")
def rec_state_stream(spark, sf_dir):
    """The whole state of each recommendation, with bulk approvals and undos, kept by a stream over several micro-batches."""
    kinds = {"click": "approve", "error": "dismiss", "view": "edit", "purchase": "order_placed", "signup": "outcome"}
    kind = F.when(F.col("event_id") % 97 == 0, "approve_all").when(F.col("event_id") % 11 == 0, "unapprove").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")))
    log = arriving(spark, sf_dir).select((F.col("user_id") % 20).alias("session_id"), (F.col("event_id") % 500).alias("item_no"), kind.alias("action"), "value", "ts", "event_id")
    items = drained(actions.rec_state(log.where("action <> 'approve_all'"), ["session_id", "item_no"], decided=True), ["session_id", "item_no"])
    bulk = drained(log.where("action = 'approve_all'").groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("bulk")), ["session_id"])
    return actions.with_bulk(items, bulk)


@query("throttle_windows", """SELECT user_id AS key, t AS window_start, count(*) AS hits FROM (SELECT user_id, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes', time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '10 minutes']) AS t FROM events) GROUP BY ALL""")
def throttle_windows(spark, sf_dir):
    """Hits of each key in sliding windows of 15 minutes, every 5 minutes; an event may come 1 hour late, after that its windows are
    closed and their state is dropped."""
    e = arriving(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    counts = e.groupBy(F.window("at", "15 minutes", "5 minutes"), F.col("user_id").alias("key")).agg(F.count("*").alias("hits"))
    return drained(counts.select("key", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "hits"), ["key", "window_start"])


@query("throttle_stream", "SELECT event_id, user_id AS key, count(*) OVER w AS hits, count(*) OVER w > 3 AS exceeded FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '863999999999 microseconds' PRECEDING AND CURRENT ROW)")
def throttle_stream(spark, sf_dir):
    """The exact throttle as a stream: the same rows as throttle_exceeded, from events that come up to an hour late."""
    out = hits.trailing_hits(arriving(spark, sf_dir).withColumn("key", F.col("user_id")), 864000, "1 hour")
    return drained(out, ["event_id", "key"]).withColumn("exceeded", F.col("hits") > 3)
