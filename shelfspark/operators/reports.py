"""Set-wise reports over recommendations and health reports: groups, counts, diffs, alerts, order sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalars import csv_safe_cell, effective

from . import decisions
from .ordered import Number, in_order, plain

UNKNOWN = "Unknown supplier"


def valid(recs: DataFrame) -> DataFrame:
    return recs.where(~F.coalesce("error", F.lit(False)))


def with_effective(recs: DataFrame) -> DataFrame:
    return recs.withColumns({"eff_supplier": F.coalesce(F.nullif(F.trim(effective(F.col("edited_supplier"), F.col("supplier"))), F.lit("")), F.lit(UNKNOWN)), "eff_quantity": effective(F.col("edited_quantity"), F.col("suggested").cast("string"))})


def with_order_by(recs: DataFrame, as_of: Column) -> DataFrame:
    out = recs.withColumn("buffer_days", decisions.buffer_days(F.col("days_of_supply"), F.col("lead_days"))).withColumn("order_status", decisions.order_status(F.col("buffer_days")))
    date = F.date_add(as_of, F.col("buffer_days"))
    return out.withColumn("order_by", F.when(F.col("buffer_days").isNotNull(), date)).withColumn("order_text", decisions.order_by_text(F.col("order_status"), date))


def supplier_groups(recs: DataFrame) -> DataFrame:
    rows = with_effective(valid(recs))
    return rows.groupBy("session_id", F.col("eff_supplier").alias("supplier")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "LOW").alias("low"), F.min_by("risk", "pos").alias("first_risk"), F.array_sort(F.collect_set("item")).alias("items")
    )


def display_order(recs: DataFrame) -> DataFrame:
    """recs with group figures and display_number: groups by critical items, size and name; in a group by urgency."""
    rows = with_effective(valid(recs))
    groups = rows.groupBy("session_id", "eff_supplier").agg(F.count_if(F.col("status") == "CRITICAL").alias("group_critical"), F.count("*").alias("group_n"))
    rows = rows.join(groups, ["session_id", "eff_supplier"])
    return plain(in_order(rows, ["session_id"], [F.desc("group_critical"), F.desc("group_n"), F.lower("eff_supplier"), "eff_supplier", *urgency()], {"display_number": Number()}))


def urgency() -> list[Column]:
    """The order of recommendations inside a group."""
    return [decisions.urgency_rank(F.col("order_status")), F.col("buffer_days").asc_nulls_last(), F.when(F.col("status") == "CRITICAL", 0).when(F.col("status") == "LOW", 1).otherwise(2), F.col("pos")]


def order_sheet_rows(recs: DataFrame, *more: str) -> DataFrame:
    """The columns of the exported order sheet of recs with notes; cells that a spreadsheet would run as formulas are quoted."""
    qty = F.when(F.col("eff_quantity") != F.col("suggested").cast("string"), F.concat("eff_quantity", F.lit(" (AI: "), F.col("suggested").cast("string"), F.lit(")"))).otherwise(F.col("eff_quantity"))
    return recs.select(
        "session_id", "display_number", csv_safe_cell(F.col("item")).alias("item"), "stock", csv_safe_cell(qty).alias("quantity"), csv_safe_cell(F.col("eff_supplier")).alias("supplier"), "order_text",
        F.bround(F.col("days_of_supply") / 30, 1).alias("runway_months"), decisions.order_covers(F.col("eff_quantity").try_cast("double"), F.col("avg_monthly")).alias("lasts_months"), csv_safe_cell(F.col("note")).alias("notes"), *more,
    )


# The column labels of exported sheets.
LABELS = {
    "item": "Item", "stock": "On Hand", "quantity": "Qty To Order", "supplier": "Supplier", "order_text": "Order By", "runway_months": "Current Stock Lasts (months)",
    "lasts_months": "This Order Lasts (months)", "notes": "Notes",
}


def clarity_gaps(recs: DataFrame) -> DataFrame:
    """session_id, gap, n: counted gaps that a user can close; zero counts are left out."""
    rows = with_effective(valid(recs))
    counts = rows.groupBy("session_id").agg(
        F.count_if(F.col("lead_days").isNull()).alias("no_lead_time"), F.count_if(F.lower("eff_supplier").isin("unknown", UNKNOWN.lower())).alias("unknown_supplier"),
        F.count_if(F.lower("eff_quantity") == "verify with team").alias("no_quantity"), F.count_if(F.col("pattern").isin("spiky", "volatile", "lumpy")).alias("unusual_pattern"),
    )
    return counts.unpivot("session_id", ["no_lead_time", "unknown_supplier", "no_quantity", "unusual_pattern"], "gap", "n").where("n > 0")


def run_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Items of two runs (pair, item, pos, status) with their change; the last row of an item counts."""
    last = lambda df, x: df.groupBy("pair", F.trim("item").alias("item")).agg(F.max_by("status", "pos").alias(x))
    both = last(older, "was").join(last(newer, "now"), ["pair", "item"], "full_outer")
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").when(F.col("was") == F.col("now"), "unchanged").when(F.col("now") == "CRITICAL", "escalated")
        .when(F.col("was") == "CRITICAL", "improved").otherwise("status_changed")
    )
    return both.withColumn("change", change)


def newly_critical(now: DataFrame, before: DataFrame) -> DataFrame:
    """Critical items (session_id, item) that were not critical in the organisation's run before it (same columns, shifted)."""
    critical = lambda df: df.where("status = 'CRITICAL'").select("session_id", F.trim("item").alias("item")).distinct()
    return critical(now).join(critical(before), ["session_id", "item"], "left_anti")


def first_k(rows: DataFrame, bucket: Column, limits: dict[str, int], order: str = "pos") -> DataFrame:
    """The first limits[bucket] rows of each session's buckets, in report order."""
    limit = F.coalesce(*[F.when(F.col("bucket") == k, F.lit(n)) for k, n in limits.items()])
    ranked = rows.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "bucket").orderBy(order)))
    return ranked.where(F.col("rank") <= limit)


def verify_report(report: DataFrame, truth: DataFrame) -> DataFrame:
    """report (session_id, item, status, days_of_supply, spoilage) corrected by truth (session_id, item, status, days_of_supply, sold).

    A DEAD label stays where nothing was sold; days are replaced if missing or off by more than max(3, a tenth), except for DEAD items, whose
    spoilage becomes NONE. fixed counts the changes of a row."""
    t = truth.select("session_id", "item", F.col("status").alias("true_status"), F.col("days_of_supply").alias("true_days"), "sold")
    j = report.join(t, ["session_id", "item"], "left")
    keep = F.col("true_status").isNull() | ((F.col("status") == "DEAD") & (F.col("sold") == 0))
    j = j.withColumn("new_status", F.when(keep, F.col("status")).otherwise(F.col("true_status")))
    dead = F.col("new_status") == "DEAD"
    off = F.col("days_of_supply").isNull() | (F.abs(F.col("days_of_supply") - F.col("true_days")) > F.greatest(F.lit(3.0), F.col("true_days") / 10))
    j = j.withColumn("new_days", F.when(~dead & F.col("true_days").isNotNull() & off, F.col("true_days")).otherwise(F.col("days_of_supply"))).withColumn("new_spoilage", F.when(dead, "NONE").otherwise(F.col("spoilage")))
    fixed = sum((F.coalesce((~F.col(a).eqNullSafe(F.col(b))).cast("int"), F.lit(0)) for a, b in (("new_status", "status"), ("new_days", "days_of_supply"), ("new_spoilage", "spoilage"))), F.lit(0))
    return j.select("session_id", "item", F.col("new_status").alias("status"), F.col("new_days").alias("days_of_supply"), F.col("new_spoilage").alias("spoilage"), fixed.alias("fixed"))
