"""Writing results by session: reruns replace what they wrote before, and readers see finished sessions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKS = "_commits"
#: Cells as written: quotes are doubled, blanks stay, cells may hold line ends; a blank cell is read as null.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "multiLine": True, "encoding": "UTF-8"}


def _spread(rows: DataFrame, by: str, order: list[Column | str]) -> DataFrame:
    """Rows in ranges of (by, order), so that a session's rows lie together and a very large session in several files."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)


def _of(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are among those of chosen, nulls included."""
    some = chosen.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return rows.join(some, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")


def write_sessions(rows: DataFrame, path: str, by: str = "session_id", order: list[Column | str] | None = None) -> None:
    """Writes rows as Parquet in a folder for each value of `by`. A session that is written again is replaced, others stay. Each session's
    number of rows is written behind its data, as its commit mark: a session whose write was cut short has none, or another number, and is
    not read until a rerun has completed it."""
    order = order or [F.xxhash64(*rows.columns)]
    _spread(rows, by, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    done = _of(rows.sparkSession.read.schema(rows.schema).parquet(path), rows.select(by).distinct(), [by])
    marks = done.groupBy(by).agg(F.count("*").alias("n_rows"), F.current_timestamp().alias("written_at"))
    marks.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{MARKS}")


def commits(spark: SparkSession, path: str, schema: StructType, by: str = "session_id") -> DataFrame:
    kind = schema[by].dataType.simpleString()
    return spark.read.schema(f"n_rows long, written_at timestamp, {by} {kind}").parquet(f"{path}/{MARKS}")


def read_sessions(spark: SparkSession, path: str, schema: StructType, by: str = "session_id") -> DataFrame:
    """The rows of finished sessions."""
    rows = spark.read.schema(schema).parquet(path)
    whole = _of(rows.groupBy(by).agg(F.count("*").alias("n_rows")), commits(spark, path, schema, by), [by, "n_rows"])
    return _of(rows, whole, [by]).select(*schema.names)


def write_csv(rows: DataFrame, path: str, labels: dict[str, str], order: list[Column | str], by: str = "session_id") -> None:
    """Writes the columns of labels, under these labels, as CSV files in a folder for each value of `by`, in order within a file and over the
    names of a folder's files. A session that is written again is replaced."""
    files = _spread(rows, by, order).select(by, *[F.col(c).alias(label) for c, label in labels.items()])
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**CSV).partitionBy(by).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files by a schema: the columns in file order, then the column of the folders."""
    return spark.read.options(**CSV).schema(schema).csv(path)
