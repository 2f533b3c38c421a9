"""Sales velocity: parsed lines, months covered, monthly vectors, demand shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalars import date_parts, match_key, month_key, to_num

from .durable import durable

MAX_MONTHS, ASSUMED_MONTHS = 24, 12


def day_first(sales: DataFrame) -> DataFrame:
    """session_id, day_first: D/M/Y unless some second number, and no first number, is over 12."""
    p = date_parts(F.col("date_raw"))
    return sales.groupBy("session_id").agg((F.coalesce(F.bool_or(p["a"] > 12), F.lit(False)) | ~F.coalesce(F.bool_or(p["b"] > 12), F.lit(False))).alias("day_first"))


def read_dates(dates: DataFrame) -> DataFrame:
    """session_id, date_raw, month of distinct dates. A session has few of them, so each is read once; all of them decide the order of day
    and month."""
    return dates.join(day_first(dates), "session_id").select("session_id", "date_raw", month_key(F.col("date_raw"), F.col("day_first")).alias("month"))


LINE_KEYS, LINE_SUMS = ["session_id", "item_raw", "item_no"], ["qty", "revenue", "n", "stated_sum", "n_stated"]


def by_date(sales: DataFrame) -> DataFrame:
    """Sales lines read and added up by session_id, item_raw, item_no and date_raw: qty and revenue (decimals), n (lines), stated_sum and
    n_stated of the stated monthly averages. Sums of different files of a session can be put together; what a date means cannot be known
    before all dates of its session are. Quantities are whole or two-decimal numbers, so decimal sums are exact."""
    avg = to_num(F.col("avg_raw"))
    return sales.groupBy(*LINE_KEYS, "date_raw").agg(
        F.sum(to_num(F.col("qty_raw")).cast("decimal(18,2)")).alias("qty"), F.sum(to_num(F.col("rev_raw")).cast("decimal(18,2)")).alias("revenue"), F.count("*").alias("n"), F.sum(avg).alias("stated_sum"), F.count(avg).alias("n_stated")
    )


def by_month(dated: DataFrame) -> DataFrame:
    """Sums by date (of one or more files) added up by session_id, item_raw, item_no and month, with n_dated (lines with a date text)."""
    months = read_dates(dated.select("session_id", "date_raw").distinct())
    n_dated = F.when(F.trim("date_raw") != "", F.col("n")).otherwise(0)
    sums = [F.sum(c).alias(c) for c in LINE_SUMS]
    return dated.join(months, ["session_id", "date_raw"], "left").groupBy(*LINE_KEYS, "month").agg(*sums, F.sum(n_dated).alias("n_dated"))


def sales_cube(sales: DataFrame) -> DataFrame:
    """Sales by month. Everything about amounts and months follows from it, and it is written, so the facts are scanned once."""
    return durable(by_month(durable(by_date(sales), "sales-by-date")), "sales-cube")


def sales_velocity(cube: DataFrame, keys: list[str]) -> DataFrame:
    """total_qty, total_revenue, n_rows, stated_avg (of the lines that state one; blanks do not count) by keys."""
    return cube.groupBy(*keys).agg(
        F.sum("qty").cast("double").alias("total_qty"), F.sum("revenue").cast("double").alias("total_revenue"), F.sum("n").alias("n_rows"), F.try_divide(F.sum("stated_sum"), F.sum("n_stated")).alias("stated_avg")
    )


def months_covered(cube: DataFrame) -> DataFrame:
    """session_id, months: distinct months, null when under half of the non-blank dates are readable."""
    read = F.sum(F.when(F.col("month").isNotNull(), F.col("n_dated")).otherwise(0))
    return cube.groupBy("session_id").agg(F.when((2 * read >= F.sum("n_dated")) & (F.sum("n_dated") > 0), F.greatest(F.lit(1), F.count_distinct("month"))).alias("months"))


def months_resolved(covered: DataFrame, inferred: DataFrame) -> DataFrame:
    """session_id, months, basis: months from dates, else inferred from stated averages, else ASSUMED_MONTHS (worth a note to the user)."""
    both = covered.join(inferred, "session_id", "left")
    basis = F.when(F.col("months").isNotNull(), "dates").when(F.col("inferred").isNotNull(), "inferred").otherwise("assumed")
    return both.select("session_id", F.coalesce("months", "inferred", F.lit(ASSUMED_MONTHS)).cast("bigint").alias("months"), basis.alias("basis"))


def avg_monthly(stated: Column, spiky_median: Column, total: Column, months: Column) -> Column:
    """A stated average counts as it is; on the derived path a spiky item is sized on its median month, never on the inflated mean."""
    return F.when(stated > 0, stated).when(spiky_median > 0, spiky_median).when(total > 0, total / months).otherwise(0.0)


def months_inferred(items: DataFrame) -> DataFrame:
    """session_id, inferred: the upper median over items of total / stated average, for ratios in [0.25, 60]."""
    ratio = F.when(F.col("stated_avg") > 0, F.col("total_qty") / F.col("stated_avg"))
    some = items.where("total_qty > 0").select("session_id", ratio.alias("r")).where("r BETWEEN 0.25 AND 60")
    at = Window.partitionBy("session_id").orderBy("r")
    ranked = some.select("session_id", "r", F.row_number().over(at).alias("i"), F.count("*").over(Window.partitionBy("session_id")).alias("n"))
    return ranked.where("i = floor(n / 2) + 1").select("session_id", F.greatest(F.lit(1), F.bround("r", 0).cast("bigint")).alias("inferred"))


def monthly_vectors(cube: DataFrame, key: str = "key") -> DataFrame:
    """session_id, key, month, qty: each key's zero-filled quantities over the session's latest MAX_MONTHS covered months."""
    sums = cube.where("month IS NOT NULL").groupBy("session_id", key, "month").agg(F.sum("qty").cast("double").alias("qty"))
    latest = Window.partitionBy("session_id").orderBy(F.desc("month"))
    months = sums.select("session_id", "month").distinct().withColumn("r", F.row_number().over(latest)).where(f"r <= {MAX_MONTHS}").groupBy("session_id").agg(F.collect_list("month").alias("months"))
    sold = sums.groupBy("session_id", key).agg(F.map_from_entries(F.collect_list(F.struct("month", "qty"))).alias("sold"))
    grid = sold.join(months, "session_id").select("session_id", key, "sold", F.explode("months").alias("month"))  # at most MAX_MONTHS rows a key
    return grid.select("session_id", key, "month", F.coalesce(F.element_at("sold", F.col("month")), F.lit(0.0)).alias("qty"))


def pattern_stats(vectors: DataFrame, key: str = "key") -> DataFrame:
    q = F.col("qty")
    return vectors.groupBy("session_id", key).agg(
        F.count("*").alias("n"), F.sum(q.cast("decimal(18,2)")).cast("double").alias("total"), F.median(q).alias("median"), F.min(q).alias("low"), F.max(q).alias("high"),
        F.count_if(q <= 0).alias("zeros"), F.min(F.when(q > 0, q)).alias("low_sold"), F.max(F.when(q > 0, q)).alias("high_sold"),
    )


def pattern_class(n: Column, total: Column, median: Column, zeros: Column, low: Column, high: Column) -> Column:
    return (
        F.when((n < 4) | (total <= 0), "stable").when(zeros * 2 >= n, "lumpy").when((median > 0) & (total / n >= 2 * median), "spiky")
        .when((median > 0) & ((high >= 3 * low) | (zeros >= 1)), "volatile").otherwise("stable")
    )


def demand_shapes(vectors: DataFrame, key: str = "key") -> DataFrame:
    """session_id, key, n, mean, median, low, high, zeros, pattern, corrected (the median, for spiky items)."""
    s = pattern_stats(vectors, key)
    s = s.withColumn("pattern", pattern_class(*[F.col(c) for c in ("n", "total", "median", "zeros", "low_sold", "high_sold")]))
    return s.select("session_id", key, "n", F.bround(F.col("total") / F.col("n"), 1).alias("mean"), F.bround("median", 1).alias("median"), "low", "high", "zeros", "pattern", F.when(F.col("pattern") == "spiky", F.col("median")).alias("corrected"))


def item_figures(cube: DataFrame, key: str = "key") -> DataFrame:
    """session_id, key, total_qty, total_revenue, n_rows, stated_avg, pattern, corrected: what the sales alone say about an item."""
    shapes = demand_shapes(monthly_vectors(cube, key), key).select("session_id", key, "pattern", "corrected")
    return sales_velocity(cube, ["session_id", key]).join(shapes, ["session_id", key], "left")


def with_shape(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """rows (session_id, key of the canonical name, own_key) with pattern and corrected of the canonical name, else of the own name."""
    found = shapes.select("session_id", "key", F.struct("pattern", "corrected").alias("first"))
    own = found.toDF("session_id", "own_key", "second")
    both = rows.join(found, ["session_id", "key"], "left").join(own, ["session_id", "own_key"], "left")
    shape = F.coalesce("first", "second")
    return both.withColumns({"pattern": shape["pattern"], "corrected": shape["corrected"]}).drop("first", "second")


def with_keys(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Sales lines (or a cube of them) with the inventory key of their name; lines of dropped names go."""
    return lines.join(matched.withColumnRenamed("name", "item_raw").drop("how"), ["session_id", "item_raw"]).where("key IS NOT NULL")


def raw_key(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """lines keyed by their own name; a name that stands for another item than its key says (see names.match_names) lends its shape to none."""
    own = match_key(F.col("item_raw"))
    how = matched.select("session_id", F.col("name").alias("item_raw"), F.col("key").alias("stands_for"), "how")
    other = F.col("how").isin("cut", "ambiguous") & ~F.col("stands_for").eqNullSafe(own)
    return lines.join(how, ["session_id", "item_raw"], "left").withColumn("key", F.when(other, F.concat(F.lit("~"), own)).otherwise(own)).drop("stands_for", "how")
