"""Month grids to dated sales rows, each file routed by its outcome: refused (with the reason, and no rows), degraded or confident."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalars import is_total_label, lead_time_days, num_cell

from .durable import durable
from .ingest import assumed_year, recipe_refusals
from .ordered import Fill, in_order, plain

MIXED_SHARE, FLAT_SHARE, SURE_SHARE = 0.2, 0.5, 0.9
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
EXACT = "decimal(28,6)"


@dataclass(frozen=True)
class Conversion:
    """rows: file, row_no, item, date, qty, supplier, lead_days. readback: a row for each recipe, file, outcome, reason, items, months_kept,
    months_dropped, assumed_year, total_units, question (nulls where refused)."""

    rows: DataFrame
    readback: DataFrame


def grid_rows(cells: DataFrame, recipes: DataFrame) -> DataFrame:
    """file, row_no, item, supplier, lead_text, months (month to cell text) of the item rows below the header: one shuffle of the cells that
    a recipe names. Rows without an item name and total rows are left out."""
    one = lambda c, role: F.struct(F.col(c).alias("col_no"), F.lit(role).alias("role"), F.lit(None).cast("int").alias("month"))
    months = F.transform(F.map_entries("month_cols"), lambda e: F.struct(e["key"].alias("col_no"), F.lit("month").alias("role"), e["value"].alias("month")))
    roles = recipes.select("file", "header_row", F.explode(F.concat(F.array(one("item_col", "item"), one("supplier_col", "supplier"), one("leadtime_col", "lead")), months)).alias("r")).select("file", "header_row", "r.*").where("col_no IS NOT NULL")
    text = lambda role: F.max(F.when(F.col("role") == role, F.trim("value")))
    named = cells.join(roles, ["file", "col_no"]).where("row_no > header_row")
    pairs = F.collect_list(F.when(F.col("role") == "month", F.struct("month", F.trim("value").alias("value"))))
    rows = named.groupBy("file", "row_no").agg(text("item").alias("item"), F.nullif(text("supplier"), F.lit("")).alias("supplier"), F.nullif(text("lead"), F.lit("")).alias("lead_text"), F.map_from_entries(pairs).alias("months"))
    return rows.where((F.col("item") != "") & ~is_total_label(F.col("item")))


def month_facts(rows: DataFrame) -> DataFrame:
    """file, month, numbers_from_here, then counts: numbers, texts, positive (numbers above zero), flat (these that repeat in all later
    numbers), pairs and equal_pairs (positive numbers whose next month has a number, has the same), units.

    numbers_from_here is how many numbers an item has from that month on. Which months hold any number is known only after all rows were
    read; keyed by this count, one pass suffices: an item has numbers throughout if it has as many as there are such months."""
    number = rows.select("file", F.transform_values("months", lambda _, v: num_cell(v)).alias("n"), F.col("months").alias("t"))
    later = lambda m: F.array_compact(F.transform(F.sequence(m, F.lit(12)), lambda j: F.col("n")[j]))
    each = number.withColumn("month", F.explode(F.map_keys("t")))
    each = each.select("file", "month", F.col("n")[F.col("month")].alias("q"), F.col("n")[F.col("month") + 1].alias("next"), (F.col("t")[F.col("month")] != "").alias("full"), later(F.col("month")).alias("tail"))
    up = F.col("q") > 0
    return each.groupBy("file", "month", F.size("tail").alias("numbers_from_here")).agg(
        F.count("q").alias("numbers"), F.count_if(F.col("q").isNull() & F.col("full")).alias("texts"), F.count_if(up).alias("positive"), F.count_if(up & (F.array_max("tail") == F.array_min("tail"))).alias("flat"),
        F.count_if(up & F.col("next").isNotNull()).alias("pairs"), F.count_if(up & (F.col("next") == F.col("q"))).alias("equal_pairs"), F.sum(F.col("q").cast(EXACT)).alias("units"),
    )


def routes(recipes: DataFrame, facts: DataFrame) -> DataFrame:
    """file, reason, kept, dropped (months), borderline (month kept although the tail repeats it), mixed (months). At most twelve months a
    file, so a file's facts are folded in one row."""
    fact = ("numbers", "texts", "pairs", "equal_pairs")
    by_month = facts.groupBy("file", "month").agg(*[F.sum(c).alias(c) for c in fact], F.collect_list(F.struct(F.col("numbers_from_here").alias("k"), "positive", "flat")).alias("tails"))
    m = recipes.select("file", F.explode(F.map_values("month_cols")).alias("month")).join(by_month, ["file", "month"], "left").na.fill(0, fact)
    # the months from here on that hold a number tell how long a whole tail is: twelve rows a file
    files = m.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("month", *fact, "tails"))).alias("m"))
    where = lambda test: F.transform(F.filter("m", test), lambda x: x["month"])
    files = files.withColumns({
        "live": where(lambda x: x["numbers"] > 0),
        "texts_only": where(lambda x: (x["numbers"] == 0) & (x["texts"] > 0)),
        "mixed": where(lambda x: (x["numbers"] > 0) & (x["texts"] > 0) & (x["texts"] >= F.lit(MIXED_SHARE) * (x["texts"] + x["numbers"]))),
    })

    def passes(x: Column) -> Column:
        whole = F.filter(F.coalesce(x["tails"], F.array()), lambda t: t["k"] == F.size(F.filter("live", lambda v: v >= x["month"])))
        count = lambda c: F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, t: a + t[c])
        return (count("positive") > 0) & (count("flat") >= F.lit(FLAT_SHARE) * count("positive"))

    inner = F.filter("m", lambda x: (x["numbers"] > 0) & (x["month"] > F.array_min("live")) & (x["month"] < F.array_max("live")))
    walk = F.aggregate(
        F.reverse(inner), F.struct(F.lit(True).alias("go"), F.lit(99).alias("cut")),
        lambda s, x: F.struct((s["go"] & passes(x)).alias("go"), F.when(s["go"] & passes(x), x["month"]).otherwise(s["cut"]).alias("cut")),
    )
    files = files.withColumn("cut", walk["cut"])
    edge = F.get(F.filter("m", lambda x: x["month"] == F.col("cut")), F.lit(0))
    rescued = (F.col("cut") < 99) & F.exists("m", lambda x: x["month"] == F.col("cut") + 1) & (edge["equal_pairs"] / F.nullif(edge["pairs"], F.lit(0)) < SURE_SHARE)
    files = files.withColumn("borderline", F.when(rescued, F.col("cut")))
    kept = F.filter("live", lambda v: (v < F.col("cut")) | (v == F.coalesce("borderline", F.lit(0))))
    reason = F.when(F.size("texts_only") > 0, F.concat(F.lit("the column of "), _names(F.slice("texts_only", 1, 1)), F.lit(" holds texts, no quantities"))).when(F.size("live") == 0, "no month has a number")
    return files.select("file", reason.alias("reason"), kept.alias("kept"), F.filter(F.transform("m", lambda x: x["month"]), lambda v: ~F.array_contains(kept, v)).alias("dropped"), "borderline", "mixed")


def _names(months: Column) -> Column:
    return F.array_join(F.transform(months, lambda v: F.element_at(F.array(*map(F.lit, MONTHS)), v)), ", ")


def block_values(rows: DataFrame) -> DataFrame:
    """rows (file, row_no, supplier, lead_text) with supplier filled down and lead_days carried within its block: a change of supplier starts
    a block, a repeated one does not, lead text that says nothing clears the value. A file's rows may lie in many tasks."""
    filled = in_order(rows, ["file"], ["row_no"], {"filled": Fill("supplier"), "above": Fill("supplier", before=True)})
    change = F.col("supplier").isNotNull() & ~F.col("supplier").eqNullSafe(F.col("above"))
    lead = F.struct(F.when(F.col("lead_text").isNotNull(), lead_time_days(F.col("lead_text"))).alias("days"))
    event = filled.withColumn("event", F.when(change | F.col("lead_text").isNotNull(), lead))
    carried = plain(in_order(event, ["file"], ["row_no"], {"carried": Fill("event")}))
    return carried.withColumn("supplier", F.col("filled")).withColumn("lead_days", F.col("carried")["days"]).drop("filled", "above", "event", "carried", "lead_text")


def convert(cells: DataFrame, recipes: DataFrame, as_of: Column) -> Conversion:
    """cells (file, row_no, col_no, value) by recipes (file, layout, header_row, item_col, month_cols, supplier_col, leadtime_col, n_rows,
    n_cols). A recipe that does not hold refuses its file; so do a month of texts only, a grid without numbers, and converted sums that
    differ from the grid's."""
    checked = durable(recipes.join(recipe_refusals(recipes), "file"), "recipes")
    sound = checked.where(F.size("reasons") == 0)
    grid = durable(grid_rows(cells, sound), "grid")
    facts = durable(month_facts(grid), "facts")
    route = durable(routes(sound, facts), "routes")
    good = route.where("reason IS NULL").select("file", "kept", assumed_year(F.array_max("kept"), as_of).cast("int").alias("year"))

    each = block_values(grid).join(good, "file").select("file", "row_no", "item", "supplier", "lead_days", "kept", "year", F.explode("months").alias("month", "value"))
    each = each.where(F.array_contains("kept", F.col("month"))).withColumn("qty", num_cell(F.col("value"))).where("qty IS NOT NULL")
    rows = durable(each.select("file", "row_no", "item", F.make_date("year", "month", F.lit(15)).alias("date"), "qty", "supplier", "lead_days"), "converted")

    exact = F.sum(F.col("qty").cast(EXACT))
    got = rows.groupBy("file", F.month("date").alias("month")).agg(exact.alias("got"))
    want = facts.groupBy("file", "month").agg(F.sum("units").alias("want")).join(good, "file").where(F.array_contains("kept", F.col("month")))
    off = want.join(got, ["file", "month"], "full").groupBy("file").agg(F.bool_or(F.abs(F.coalesce("got", F.lit(0)) - F.coalesce("want", F.lit(0))) > F.lit("0.000001").cast(EXACT)).alias("off"), F.sum("got").cast("double").alias("units"))
    # a row that only has texts in its months is still an item of the file
    items = grid.groupBy("file").agg(F.count("*").alias("items"))

    all_ = checked.select("file", "reasons").join(route, "file", "left").join(good.select("file", "year"), "file", "left").join(items, "file", "left").join(off, "file", "left")
    reason = F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(F.coalesce("reason", F.when(F.col("off"), "converted sums differ from the file's")))
    all_ = all_.withColumn("reason", reason)
    ask = F.concat_ws(
        " ",
        F.when(F.col("borderline").isNotNull(), F.concat(F.lit("Did "), _names(F.array("borderline")), F.lit(" happen? It was kept, but the months behind it repeat one value like a plan."))),
        F.when(F.size("mixed") > 0, F.concat(F.lit("Please check "), _names(F.col("mixed")), F.lit(": some of its cells are no numbers."))),
    )
    good_only = lambda c: F.when(F.col("reason").isNull(), c)
    degraded = F.col("borderline").isNotNull() | (F.size("mixed") > 0)
    readback = all_.select(
        "file", F.when(F.col("reason").isNotNull(), "refused").when(degraded, "degraded").otherwise("confident").alias("outcome"), "reason", good_only(F.coalesce("items", F.lit(0))).alias("items"),
        good_only(F.col("kept")).alias("months_kept"), good_only(F.col("dropped")).alias("months_dropped"), good_only(F.col("year")).alias("assumed_year"), good_only(F.round("units", 1)).alias("total_units"), good_only(F.nullif(ask, F.lit(""))).alias("question"),
    )
    bad = off.where("off").select("file")
    return Conversion(rows.join(bad, "file", "left_anti"), readback)
