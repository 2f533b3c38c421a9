"""Row cleaning of inventory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalars import is_total_row, match_key, to_num

from .ordered import Fill, in_order, plain


def drop_totals(rows: DataFrame, name: str = "item", unit: str | None = "uom_raw") -> DataFrame:
    return rows.where(~F.coalesce(is_total_row(F.col(name), F.col(unit) if unit else None), F.lit(False)))


def fill_down(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The last non-blank value of column at or above each row of its session, in row order."""
    own = rows.withColumn("__own", F.nullif(F.trim(column), F.lit("")))
    return plain(in_order(own, ["session_id"], ["row_no"], {out: Fill("__own")})).drop("__own")


def readable_stock(rows: DataFrame) -> DataFrame:
    """stock: the number of stock_raw, null where blank, unreadable or negative; unreadable marks those rows."""
    n = to_num(F.col("stock_raw"))
    return rows.withColumn("stock", F.when(n >= 0, n)).withColumn("unreadable", F.col("stock").isNull())


def merge_split_rows(rows: DataFrame) -> DataFrame:
    """One row per (session, item key, unit): stock of rows with the first non-blank unit, or a blank one, is added up; rows with another
    unit stay as they are. The first row gives the names."""
    keyed = rows.withColumn("key", match_key(F.col("item"))).withColumn("unit", F.nullif(F.upper(F.trim("uom_raw")), F.lit("")))
    group = Window.partitionBy("session_id", "key").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = keyed.withColumn("first_unit", F.first("unit", ignorenulls=True).over(group))
    apart = F.col("unit").isNotNull() & (F.col("unit") != F.col("first_unit")) | (F.col("key") == "")
    own = own.withColumn("alone", F.when(apart, F.col("row_no")))
    return own.groupBy("session_id", "key", "alone").agg(
        F.min_by("item", "row_no").alias("item"), F.min("row_no").alias("row_no"), F.min_by("category", "row_no").alias("category"), F.coalesce(F.min("first_unit"), F.lit("")).alias("first_unit"),
        F.min_by(F.coalesce("unit", F.lit("")), "row_no").alias("own_unit"), F.sum("stock").alias("stock"), F.count("*").alias("n_rows"), F.min_by("org_name", "row_no").alias("org_name"),
    ).select("session_id", "org_name", "key", "item", "row_no", "category", F.when(F.col("alone").isNull(), F.col("first_unit")).otherwise(F.col("own_unit")).alias("uom"), "stock", "n_rows")
