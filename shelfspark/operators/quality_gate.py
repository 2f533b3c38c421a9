"""The data-quality gate: findings of every session at once. A BLOCK hides the findings after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import euro_number, looks_unit, to_num

LARGE, FEW_NUMBERS, MANY_EURO, LOW_OVERLAP, MIN_NAMES = 4000, 0.10, 0.30, 0.20, 5


def dominant_unit(rows: DataFrame) -> DataFrame:
    """session_id, unit: the most frequent unit (ties: the first by name); only words that look like units count."""
    counts = rows.where(looks_unit(F.col("uom_raw"))).groupBy("session_id", F.upper(F.trim("uom_raw")).alias("unit")).agg(F.count("*").alias("n"))
    return counts.groupBy("session_id").agg(F.min_by("unit", F.struct(-F.col("n"), "unit")).alias("unit"))


def findings(sessions: DataFrame, inventory: DataFrame, sales: DataFrame, overlap: DataFrame) -> DataFrame:
    """session_id, level, code. overlap: session_id, names, matched (distinct sales names, and those that reach an inventory item)."""
    filled = F.trim(F.col("stock_raw")) != ""
    numlike = to_num(F.col("stock_raw")).isNotNull() | euro_number(F.col("stock_raw"))
    inv = inventory.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.count_if(filled).alias("n_filled"), F.count_if(filled & numlike).alias("n_numbers"))
    cells = inventory.select("session_id", F.col("stock_raw").alias("x")).unionByName(sales.select("session_id", F.col("qty_raw").alias("x"))).where(F.trim("x") != "")
    euro = cells.groupBy("session_id").agg((F.count_if(euro_number(F.col("x"))) / F.count("*")).alias("euro"))
    units = dominant_unit(inventory).withColumnRenamed("unit", "unit_i").join(dominant_unit(sales).withColumnRenamed("unit", "unit_s"), "session_id")
    j = sessions.join(inv, "session_id", "left").join(euro, "session_id", "left").join(units, "session_id", "left").join(overlap, "session_id", "left")
    f = lambda rank, level, code, c: F.when(c, F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(
        f(1, "BLOCK", "empty_file", F.col("n_rows").isNull()), f(2, "BLOCK", "stock_blank", F.col("n_filled") == 0), f(3, "BLOCK", "stock_not_numeric", (F.col("n_filled") > 0) & (F.col("n_numbers") < FEW_NUMBERS * F.col("n_filled"))),
        f(4, "WARN", "number_format", F.col("euro") >= MANY_EURO), f(5, "WARN", "low_name_overlap", (F.col("names") >= MIN_NAMES) & (F.col("matched") < LOW_OVERLAP * F.col("names"))),
        f(6, "WARN", "unit_mismatch", F.col("unit_i") != F.col("unit_s")), f(7, "WARN", "large_file", F.col("n_rows") > LARGE),
    ))
    block = F.array_min(F.transform(F.filter("found", lambda x: x["level"] == "BLOCK"), lambda x: x["rank"]))
    shown = j.select("session_id", found.alias("found")).withColumn("stop", F.coalesce(block, F.lit(99)))
    return shown.select("session_id", F.explode(F.filter("found", lambda x: x["rank"] <= F.col("stop"))).alias("f")).select("session_id", "f.level", "f.code")


def notes(months: DataFrame, stock: DataFrame, unlisted: DataFrame) -> DataFrame:
    """session_id, note, n: what a user must know to read a run. months: session_id, basis; stock: session_id, unreadable, missing (items
    without a recommendation); unlisted: session_id, unlisted (items whose supplier only the sales sheet names)."""
    note = lambda df, name, n, test: df.where(test).select("session_id", F.lit(name).alias("note"), n.cast("bigint").alias("n"))
    return (
        note(months, "assumed_months", F.lit(0), "basis = 'assumed'").unionByName(note(stock, "unreadable_stock", F.col("unreadable"), "unreadable > 0"))
        .unionByName(note(unlisted, "suppliers_from_sales", F.col("unlisted"), "unlisted > 0")).unionByName(note(stock, "reply_cut_short", F.col("missing"), "missing > 0"))
    )
