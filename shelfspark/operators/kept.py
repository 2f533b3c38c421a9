"""Tables kept from run to run, by session: batches are added, and what follows from them is computed anew only for sessions that changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .durable import durable

@dataclass(frozen=True)
class Kept:
    """A table of rows by session in a shared folder. Every write has folders of its own: its rows (a folder for each session), its sessions
    with a version that follows from their content, and behind them a mark of one row. A write that was cut short has no mark and is not
    read; a rerun takes its place. Rows without a session (null or blank) belong to no analysis and are not kept.

    A table is filled either by `append` (the rows of a session are those of all batches) or by `refresh` (those of its last refresh)."""

    spark: SparkSession
    path: str
    schema: StructType

    def create(self) -> Kept:
        """Makes the folders; a table that is there stays as it is."""
        kind = self.schema["session_id"].dataType.simpleString()
        empty = lambda s: self.spark.createDataFrame([], s).write.mode("ignore")
        empty(StructType([*self.schema.fields]).add("write", "string")).partitionBy("write", "session_id").parquet(f"{self.path}/rows")
        empty(f"session_id {kind}, version long, write string").partitionBy("write").parquet(f"{self.path}/sessions")
        empty("seq long, batch string, write string").partitionBy("write").parquet(f"{self.path}/marks")
        return self

    def _table(self, name: str) -> DataFrame:
        kind = self.schema["session_id"].dataType.simpleString()
        schema = {"rows": StructType([*self.schema.fields]).add("write", "string"), "sessions": f"session_id {kind}, version long, write string", "marks": "seq long, batch string, write string"}
        return self.spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, batch: str | None, sessions: DataFrame | None = None) -> None:
        """Writes rows, then their sessions (given, or with versions from their rows), then the mark."""
        write = uuid.uuid4().hex
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        names = self.schema.names
        hashed = F.xxhash64(*names)
        rows = rows.select(*names).where(F.trim(F.col("session_id").cast("string")) != "")
        rows.repartitionByRange(n, "session_id", hashed).sortWithinPartitions("session_id").write.partitionBy("session_id").parquet(f"{self.path}/rows/write={write}")
        if sessions is None:
            done = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/write={write}")
            content = done.select(*names).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("h"))
            sessions = content.select("session_id", F.xxhash64(F.lit(batch), "n", "h").alias("version"))
        sessions.write.parquet(f"{self.path}/sessions/write={write}")
        last = self._table("marks").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
        last.select((F.col("seq") + 1).alias("seq"), F.lit(batch).cast("string").alias("batch")).write.parquet(f"{self.path}/marks/write={write}")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds a batch of rows; a batch of a known name takes the place of its former rows, in all sessions."""
        self._write(rows, batch)

    def pieces(self, before: int | None = None) -> DataFrame:
        """session_id, version, write, seq: what the table consists of, or consisted of before a write."""
        marks = self._table("marks") if before is None else self._table("marks").where(F.col("seq") < before)
        batches = marks.where("batch IS NOT NULL").groupBy("batch").agg(F.max(F.struct("seq", "write")).alias("m")).select("m.*")
        refreshed = marks.where("batch IS NULL").select("seq", "write")
        sessions = self._table("sessions")
        latest = sessions.join(refreshed, "write").groupBy("session_id").agg(F.max_by(F.struct("version", "write", "seq"), F.struct("seq", "write")).alias("m")).select("session_id", "m.*")
        return sessions.join(batches, "write").select("session_id", "version", "write", "seq").unionByName(latest.where("version IS NOT NULL"))

    def versions(self) -> DataFrame:
        """session_id, version: equal for equal content, in whatever writes it came."""
        some = self.pieces().groupBy("session_id").agg(F.count("*").alias("n"), F.bit_xor("version").alias("all"))
        return some.select("session_id", F.when(F.col("n") == 1, F.col("all")).otherwise(F.xxhash64("n", "all")).alias("version"))

    def rows(self, pieces: DataFrame | None = None) -> DataFrame:
        """The rows of the given pieces (all current ones). Only their folders are read while the list of pieces is small enough to be
        broadcast by its size; it is written first, so that its size is known, and compared, so that Spark prunes by it."""
        some = durable(self.pieces() if pieces is None else pieces, "pieces").where("seq > 0").select(F.col("session_id").alias("_s"), F.col("write").alias("_w"))
        rows = self._table("rows")
        return rows.join(some, (F.col("session_id") == F.col("_s")) & (F.col("write") == F.col("_w")), "left_semi").select(*self.schema.names)

    def refresh(self, source: Kept, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Brings this table up to date with f(source), where f treats each session by itself. Reads and writes only sessions whose version
        differs, those that left the source included; returns them (session_id, version)."""
        was = self.versions().withColumnRenamed("version", "was")
        stale = durable(source.versions().join(was, "session_id", "full").where(~F.col("version").eqNullSafe(F.col("was"))).select("session_id", "version"), "stale")
        if not stale.isEmpty():
            pieces = source.pieces().join(stale.select("session_id"), "session_id", "left_semi")
            self._write(f(source.rows(pieces)), None, stale)
        return stale

    def n_refreshed(self) -> DataFrame:
        """session_id, n: how often a session was computed."""
        return self._table("sessions").join(self._table("marks"), "write").groupBy("session_id").agg(F.count("*").alias("n"))

    def changes(self, keys: list[str]) -> DataFrame:
        """keys, change (added, removed, changed), before, after: what the last refresh changed in rows with unique keys (null keys are
        values). Only its sessions are read."""
        last = self._table("marks").agg(F.max("seq")).first()[0] or 0  # one number
        touched = self._table("sessions").join(self._table("marks").where(F.col("seq") == last), "write").select("session_id")
        old, new = [p.join(touched, "session_id", "left_semi") for p in (self.pieces(before=last), self.pieces())]
        values = F.struct(*[c for c in self.schema.names if c not in keys])
        now = self.rows(new).select(*keys, values.alias("after"), F.lit(True).alias("is"))
        old = self.rows(old).select(*[F.col(k).alias(f"_{k}") for k in keys], values.alias("before"), F.lit(True).alias("was"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        both = now.join(old, on, "full").where(~F.col("before").eqNullSafe(F.col("after")))
        change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
        return both.select(*[F.when(F.col("is"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], change.alias("change"), "before", "after")
